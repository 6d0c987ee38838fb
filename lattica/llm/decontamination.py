"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are sequences of plain words. An item of m words may be met with an edit distance of at most
e = floor(RATE * m) words. It is split into e + 1 pieces; by the pigeonhole principle at least one of them stands in any
such passage unchanged. Exact hits of pieces are found by rolling hashes over each whole document and verified by the
semi-global edit distance of the item within the window around the hit, computed bit-parallel (Myers).

The items are broadcast in blocks of at most BLOCK_WORDS words; a larger benchmark takes one scan for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_texts, mix64
from .words import plain_words

RATE = 0.2
BLOCK_WORDS = 1_000_000
CHUNK_WORDS = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def myers(pattern: list, window: list, most: int) -> tuple[int, int] | None:
    """The least distance of the pattern to any part of the window and where that part ends; None if it exceeds `most`."""
    m = len(pattern)
    at: dict = defaultdict(int)
    for i, word in enumerate(pattern):
        at[word] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, best = full, 0, m, None
    for j, word in enumerate(window):
        eq = at.get(word, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(d0 | plus)) & full, plus & d0
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = up << 1 & full  # a match may begin anywhere, so the first row stays 0
        plus, minus = (down << 1 | ~(d0 | up)) & full, up & d0
        if distance <= most and (best is None or distance < best[0]):
            best = distance, j + 1
    return best


class Pieces:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rate: float):
        self.items, self.rate = items, rate
        words = sorted({w for _, own in items for w in own})
        codes = mix64(np.arange(1, len(words) + 1, dtype=np.uint64)) | np.uint64(1)
        self.code = dict(zip(words, codes.tolist(), strict=True))
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, own) in enumerate(items):
            pieces = self.budget(own) + 1
            cuts = [len(own) * k // pieces for k in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                h = 0
                for w in own[a:b]:
                    h = (h * int(_STEP) + self.code[w]) & 0xFFFFFFFFFFFFFFFF
                self.at[b - a][h].append((n, a))
        self.at = {width: dict(x) for width, x in self.at.items()}
        self.maybe = {}
        for width, x in self.at.items():
            bits = np.zeros(1 << _BITS, bool)
            bits[(np.array(list(x), np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.maybe[width] = bits

    def budget(self, own: list[bytes]) -> int:
        return int(self.rate * len(own))

    def hits(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, item, offset of the piece in the item) in an array of word codes, 0 for words no item has."""
        found = []
        known = np.cumsum(np.concatenate([[0], codes == 0]))
        run = codes.copy()
        for width in range(1, max(self.at, default=0) + 1):
            if width > 1:
                if len(run) < 2:
                    break
                run = run[:-1] * _STEP + codes[width - 1 :]
            if width not in self.at:
                continue
            near = np.flatnonzero(self.maybe[width][(run >> np.uint64(64 - _BITS)).astype(np.int64)] & (known[width:] == known[: len(run)]))
            for p, h in zip(near.tolist(), run[near].tolist(), strict=True):
                found += [(p, n, a) for n, a in self.at[width].get(h, ())]
        return found

    def matches(self, words: list[bytes], hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item id, first word, end word, distance): for each item the best match, then the earliest."""
        best: dict[int, tuple[int, int, int]] = {}
        for n, begin in sorted(set(hits)):
            item, own = self.items[n]
            if n in best and best[n][0] == 0:
                continue
            e = self.budget(own)
            low = max(0, begin - e)
            window = words[low : begin + len(own) + e]
            got = myers(own, window, e)
            if got and (n not in best or got[0] < best[n][0]):
                back = myers(own[::-1], window[: got[1]][::-1], e)
                best[n] = got[0], low + got[1] - (back[1] if back else len(own)), low + got[1]
        return sorted((self.items[n][0], a, b, d) for n, (d, a, b) in best.items())


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with at least one word, in blocks of bounded size; one partition at a time comes to the driver."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    for r in rows.toLocalIterator():
        own = plain_words(r["text"])
        if not own:
            continue
        if block and size + len(own) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], own))
        size += len(own)
    if block:
        yield block


MATCH_SCHEMA = "doc_id long, mark long, item_id long, first_word long, end_word long, distance int"


def contamination_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, first_word, end_word, distance.

    Null or empty texts and items without words match nothing. Equal items each match. Repeated rows of docs give repeated
    rows. Empty tables give no rows. Columns other than doc_id and text are not read.
    """
    return _matches(keyed_texts(docs).withColumn("mark", F.lit(0).cast("long")), benchmark, rate).drop("mark")


def _matches(texts: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """texts: doc_id, text, mark, which is carried to the matches."""
    out = texts.sparkSession.createDataFrame([], MATCH_SCHEMA)
    for block in item_blocks(benchmark):
        held = texts.sparkSession.sparkContext.broadcast(block)

        def search(batches, held=held):
            pieces = Pieces(held.value, rate)
            get = pieces.code.get
            for b in batches:
                out = []
                for chunk in _chunks(zip(zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["mark"], strict=True), b["text"], strict=True)):
                    codes = [np.fromiter((get(w, 0) for w in words), np.uint64, len(words)) for _, words in chunk]
                    gap = np.zeros(1, np.uint64)
                    starts = np.cumsum([0] + [len(c) + 1 for c in codes])
                    per: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    for p, n, a in pieces.hits(np.concatenate([x for c in codes for x in (c, gap)])):
                        doc = int(np.searchsorted(starts, p, side="right")) - 1
                        per[doc].append((n, p - int(starts[doc]) - a))
                    for doc, hits in sorted(per.items()):
                        out += [(*chunk[doc][0], *m) for m in pieces.matches(chunk[doc][1], hits)]
                frame = pd.DataFrame(out, columns=["doc_id", "mark", "item_id", "first_word", "end_word", "distance"])
                yield frame.astype({"doc_id": "Int64"})

        out = out.union(texts.mapInPandas(search, MATCH_SCHEMA))
    return out


def _chunks(rows):
    held, size = [], 0
    for key, text in rows:
        words = plain_words(text)
        held.append((key, words))
        size += len(words)
        if size >= CHUNK_WORDS // 4:
            yield held
            held, size = [], 0
    if held:
        yield held


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per doc_id of docs: doc_id, contaminated, n_items, item_ids (ascending), best_distance (null if clean).

    Rows that share an id count as one document; so do those without an id, as one with a null doc_id.
    """
    found = contamination_matches(docs, benchmark, rate).distinct()
    per = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("best_distance")
    )
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct()
    joined = ids.join(per.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    none = F.array().cast("array<long>")
    return joined.select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), "best_distance",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns, in which no item was found.

    Rows that share an id (or have none) are judged each by its own text; null or empty texts stay. An empty table stays
    empty; columns of any name are carried through.
    """
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    texts = keyed_texts(docs).withColumn("mark", F.xxhash64("text"))
    found = _matches(texts, benchmark, rate).select("doc_id", "mark").distinct()
    tagged = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), mark.alias("own"))
    return tagged.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")), "left_anti").select("row.*")
