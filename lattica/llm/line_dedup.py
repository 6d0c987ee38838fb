"""Removal of repeated runs of lines, by distributed prefix doubling over line-id sequences.

A line's id is a 64-bit hash of the line without outer white space; blank lines are left out of the sequences. Lines that
occur once cannot be in a repeat and drop out first. Round j of prefix doubling ranks all suffixes by their first 2^(j+1)
lines: the pairs (rank at p, rank at p + 2^j) are reduced to distinct pairs (map side first), range-sorted, and numbered in
that order. Equal ranks are one interval of the suffix array whose common prefix is at least 2^(j+1) lines; suffixes alone
in their interval drop out. Ranks are written out each round, so a lost executor never renumbers them.

A repeat counts when it has MIN_WORDS words. Every maximal repeated run is the union of the least windows with that many
words that begin, or end, at its lines; a window of n lines is an interval of common prefix n, named by its two overlapping
power-of-two ranks. As a window has at most MIN_WORDS lines, log2(MIN_WORDS) rounds are enough for runs of any length. In
each interval the window first by (doc_id, line) stays, later ones are deleted, except where they overlap that first one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MASK63, Table, text_of

MIN_WORDS = 50
_NONE = -(1 << 63)
_LINES = "did long, th long, pos int, h long, fore int, back int"


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines from it on, and up to it, that have `least` words; 0 where there are too few."""
    reach = np.concatenate([[0], np.cumsum(words)])
    n = np.arange(len(words))
    end = np.searchsorted(reach, reach[:-1] + least)  # least e with reach[e] - reach[p] >= least
    fore = np.where(end <= len(words), end - n, 0)
    begin = np.searchsorted(reach, reach[1:] - least, side="right") - 1
    return fore, np.where(begin >= 0, n + 1 - begin, 0)


def line_rows(texts: DataFrame, least: int) -> DataFrame:
    def split(batches):
        for b in batches:
            did, th, sizes, hashes, fore, back = [], [], [], [], [], []

            def flush():
                n = np.array(sizes)
                return pd.DataFrame({
                    "did": np.repeat(np.array(did, np.int64), n), "th": np.repeat(np.array(th, np.int64), n),
                    "pos": np.concatenate([np.arange(k) for k in sizes] or [np.empty(0)]).astype(np.int32),
                    "h": np.array(hashes, np.int64), "fore": np.concatenate(fore or [np.empty(0)]).astype(np.int32),
                    "back": np.concatenate(back or [np.empty(0)]).astype(np.int32),
                })

            for d, t, text in zip(b["did"], b["th"], b["text"], strict=True):
                own = [(x, n) for x in text.split("\n") if (n := len(x.split()))]
                if not own:
                    continue
                hashes += [xxhash.xxh3_64_intdigest(x.strip().encode("utf-8", "surrogatepass")) & MASK63 for x, _ in own]
                f, k = windows(np.array([n for _, n in own]), least)
                did.append(d), th.append(t), sizes.append(len(own)), fore.append(f), back.append(k)
                if len(hashes) > 200_000:
                    yield flush()
                    did, th, sizes, hashes, fore, back = [], [], [], [], [], []
            yield flush()

    return texts.mapInPandas(split, _LINES)


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: a document's key is its id (null as the least) with its text's hash; repeated rows share one."""
    text = text_of(docs)
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NONE)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_windows(texts: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """did, th, begin, n: windows of lines (blank lines not counted) that are later copies."""
    raw = Table(line_rows(texts, least).dropDuplicates(["did", "th", "pos"]), "lines")
    often = raw.read().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    lines = Table(raw.read().join(often, "h"), "repeated-lines")
    key = ["did", "th"]
    base = lines.read()
    fore = base.where("fore > 0").select(*key, F.col("pos").alias("begin"), F.col("fore").alias("n"))
    back = base.where("back > 0").select(*key, (F.col("pos") - F.col("back") + 1).alias("begin"), F.col("back").alias("n"))
    spans = Table(fore.union(back).distinct(), "windows")
    longest = spans.read().agg(F.max("n")).first()[0] or 0
    level, ranks, named = 0, Table(base.select(*key, "pos", F.col("h").alias("r")), "rank-0"), None
    while (1 << level) <= longest:
        step = 1 << level
        at = ranks.read()
        own = spans.read().where((F.col("n") >= step) & (F.col("n") < 2 * step))
        first = at.select(*key, F.col("pos").alias("begin"), F.col("r").alias("k1"))
        last = at.select(*key, (F.col("pos")).alias("tail"), F.col("r").alias("k2"))
        got = own.join(first, [*key, "begin"]).withColumn("tail", F.col("begin") + F.col("n") - step).join(last, [*key, "tail"]).drop("tail")
        named = got if named is None else named.unionByName(got)
        if 2 * step > longest:
            break
        pairs = Table(
            at.withColumnRenamed("r", "r1").join(at.select(*key, (F.col("pos") - step).alias("pos"), F.col("r").alias("r2")), [*key, "pos"]),
            f"pairs-{level}",
        )
        again = pairs.read().groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1")
        order = Table(again.select("r1", "r2").repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2").withColumn("r", F.monotonically_increasing_id()), f"order-{level}")
        level += 1
        ranks = Table(pairs.read().join(order.read(), ["r1", "r2"]).select(*key, "pos", "r"), f"rank-{level}")
        pairs.drop()
    empty = texts.sparkSession.createDataFrame([], "did long, th long, begin int, n int")
    if named is None:
        return empty
    named = Table(named, "named")
    place = F.struct("did", "th", "begin")
    firsts = named.read().groupBy("n", "k1", "k2").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1")
    later = named.read().join(firsts, ["n", "k1", "k2"])
    same = (F.col("did") == F.col("f.did")) & (F.col("th") == F.col("f.th"))
    return later.where((~same) | (F.col("begin") >= F.col("f.begin") + F.col("n"))).select("did", "th", "begin", "n")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, text (without later copies), n_lines, n_removed, removed (array of first, end line).

    Lines are numbered from 0 with blank ones counted; n_lines counts all. Null text counts as empty and stays empty. Rows
    with the same id and text count as one document and get the same result. A null doc_id comes first in the order. A
    document all of whose lines are later copies keeps its row with an empty text.
    """
    texts = keyed(docs)
    found = Table(repeated_windows(texts, least), "later")
    per = found.read().groupBy("did", "th").agg(F.collect_set(F.struct("begin", "n")).alias("spans"))
    joined = texts.join(per, ["did", "th"], "left")
    schema = "did long, text string, n_lines long, n_removed long, removed array<struct<first:int,end:int>>"

    def cut(batches):
        for b in batches:
            out = []
            for did, text, spans in zip(b["did"], b["text"], b["spans"], strict=True):
                rows = text.split("\n") if text else []
                if spans is None or not len(spans):
                    out.append((did, text, len(rows), 0, []))
                    continue
                full = [n for n, x in enumerate(rows) if x.split()]
                gone = np.zeros(len(full), bool)
                for s in spans:
                    gone[s["begin"] : s["begin"] + s["n"]] = True
                lost = {full[n] for n in np.flatnonzero(gone)}
                runs: list[list[int]] = []
                for n in sorted(lost):
                    if runs and runs[-1][1] == n:
                        runs[-1][1] = n + 1
                    else:
                        runs.append([n, n + 1])
                kept = "\n".join(x for n, x in enumerate(rows) if n not in lost)
                out.append((did, kept, len(rows), len(lost), [{"first": a, "end": z} for a, z in runs]))
            yield pd.DataFrame(out, columns=["did", "text", "n_lines", "n_removed", "removed"])

    cleaned = joined.mapInPandas(cut, schema)
    return cleaned.select(F.when(F.col("did") != _NONE, F.col("did")).alias("doc_id"), "text", "n_lines", "n_removed", "removed")
