"""Token-id files compressed by Re-Pair grammars, with random access to each document.

A shard holds whole documents in ascending doc_id order. Its grammar is its own: in each round the frequent pairs of
adjacent ids are replaced by new nonterminals (the more frequent pair wins where two overlap, every other pair of a run of
one id), until no pair occurs MIN_PAIR times or the id space of 16 bits is used up. A pair that wins fewer than half of
MIN_PAIR places in a round takes no nonterminal and is counted again in the next. Pairs that would cross a document's
end never form, because the end id is kept out of all pairs; so each document's symbols are a range of the
payload, and with the rules' expansion lengths any document is decoded by itself.

The letters of a grammar are the distinct ids of its shard, numbered; so the vocabulary may be of any size. A shard with more
than 61,440 distinct ids is stored plainly.

File layout (little-endian): magic "RPR2", counts of documents, rules and symbols (3 x u64), ids before the shard in its
partition, count of letters, 1 if stored plainly (3 x u64); doc ids (i64) with their null flags (u8); each document's symbol
end (u64) and id end (u64); letters (u32); rules (2 x u16 each), their expansion lengths (u32); symbols (u16, u32 if plain). Files are the binary column of a table that Spark writes and
commits, so that any file system works, lost executors are retried, and no half-written file is ever read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import gather
from .shared import Table, keyed_texts
from .tokens import encoder

SHARD_IDS = 1 << 20
MIN_PAIR = 24
PAIRS_A_ROUND = 4096
DECODE_DOCS = 256
_TOP = 1 << 16
_MOST_LETTERS = _TOP - 4096
_SLOT_BITS = 18
_BARRED, _EMPTY = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)  # no pair: the symbol 65535 is never used
FILE_SCHEMA = "part int, shard int, n_ids long, file binary"


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(2654435769)) >> np.uint32(32 - _SLOT_BITS)


def _round(ids: np.ndarray, first_new: int, end_id: int, since: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """One replacement round: the shorter ids and the pairs replaced, in the order of their nonterminals.

    since: only pairs with a symbol of at least this are counted; no other pair can have become frequent by the rounds that
    made these symbols.
    """
    places = None
    left, right = ids[:-1], ids[1:]
    if since:
        new = ids >= since
        places = np.flatnonzero(new[:-1] | new[1:])
        left, right = left[places], right[places]
    pair = left.astype(np.uint32) << np.uint32(16) | right
    pair[(left == end_id) | (right == end_id)] = _BARRED
    ordered = np.sort(pair)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero((counts >= MIN_PAIR) & (ordered[starts] != _BARRED))
    often = often[np.argsort(-counts[often], kind="stable")][: min(PAIRS_A_ROUND, _TOP - 1 - first_new)]
    if not len(often):
        return None
    chosen = ordered[starts[often]]
    # Two pairs may share a slot of this table; the more frequent keeps it and the other waits for the next round.
    table_pair, table_rank = np.full(1 << _SLOT_BITS, _EMPTY, np.uint32), np.zeros(1 << _SLOT_BITS, np.uint16)
    slots = _slot(chosen)[::-1]
    table_pair[slots], table_rank[slots] = chosen[::-1], np.arange(len(chosen), dtype=np.uint16)[::-1]
    at = _slot(pair)
    hit = np.flatnonzero(table_pair[at] == pair)
    rank = np.full(len(ids) - 1, 0xFFFF, np.uint16)
    rank[hit if places is None else places[hit]] = table_rank[at[hit]]
    wins = rank != 0xFFFF
    wins[1:] &= rank[1:] <= rank[:-1]
    wins[:-1] &= rank[:-1] <= rank[1:]
    again = np.flatnonzero((rank[1:] == rank[:-1]) & (rank[1:] != 0xFFFF)) + 1
    if len(again):
        # In a run of one id each place has the same pair as the one before it; of those the second, fourth and so on lose.
        begins = np.maximum.accumulate(np.where(np.diff(again, prepend=-1) > 1, np.arange(len(again)), 0))
        wins[again[(np.arange(len(again)) - begins) % 2 == 0]] = False
    at = np.flatnonzero(wins)
    enough = np.bincount(rank[at], minlength=len(chosen)) >= MIN_PAIR // 2
    at, chosen, number = at[enough[rank[at]]], chosen[enough], np.cumsum(enough) - 1
    out = ids.copy()
    out[at] = (first_new + number[rank[at]]).astype(np.uint16)
    keep = np.ones(len(ids), bool)
    keep[at + 1] = False
    return out[keep], chosen


def repair(ids: np.ndarray, end_id: int, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n x 2) and their expansion lengths.

    After a round over all pairs come rounds over the pairs with a symbol of the round before, until none of those is
    frequent; then again one over all, until that finds none.
    """
    rules, symbols, since = np.empty((0, 2), np.uint16), ids.astype(np.uint16), 0
    while len(symbols) > 1:
        top = first_new + len(rules)
        made = _round(symbols, top, end_id, since)
        if made is None or not len(made[1]):
            if not since:
                break
            since = 0
            continue
        symbols, chosen = made
        rules = np.concatenate([rules, np.stack([chosen >> 16, chosen & 0xFFFF], 1).astype(np.uint16)])
        since = top
    return symbols, rules, expansion_lengths(rules, first_new)


def expansion_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    length = np.ones(first_new + len(rules), np.int64)
    for n, (a, b) in enumerate(rules.tolist()):
        length[first_new + n] = length[a] + length[b]
    return length[first_new:].astype(np.uint32)


def write_file(doc_ids: list, ends: np.ndarray, ids: np.ndarray, before: int, end_id: int) -> bytes:
    """ends: for each document, the number of ids up to and with its end."""
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    letters = np.flatnonzero(seen)
    wide = len(letters) > _MOST_LETTERS
    if wide:
        letters, symbols, rules, lengths = letters[:0], ids.astype("<u4"), np.empty((0, 2), np.uint16), np.empty(0, np.uint32)
        reach = np.arange(1, len(symbols) + 1)
    else:
        number = np.zeros(len(seen), np.uint16)
        number[letters] = np.arange(len(letters))
        end = int(number[end_id]) if end_id < len(seen) and seen[end_id] else _TOP - 1
        symbols, rules, lengths = repair(number[ids], end, len(letters))
        every = np.ones(_TOP, np.int64)
        every[len(letters) : len(letters) + len(rules)] = lengths
        reach = np.cumsum(every[symbols])
    symbol_ends = np.searchsorted(reach, ends) + 1
    known = np.array([0 if d is None else int(d) for d in doc_ids], "<i8")
    flags = np.array([d is None for d in doc_ids], "u1")
    head = b"RPR2" + struct.pack("<QQQQQQ", len(doc_ids), len(rules), len(symbols), before, len(letters), int(wide))
    parts = (known, flags, symbol_ends.astype("<u8"), ends.astype("<u8"), letters.astype("<u4"), rules.astype("<u2"), lengths.astype("<u4"), symbols.astype("<u4" if wide else "<u2"))
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Reads one file; decode(n) touches the symbols of document n only."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPR2":
            raise ValueError("not a token file")
        docs, rules, symbols, self.before, first_new, wide = struct.unpack_from("<QQQQQQ", data, 4)
        at = 52

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, flags = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if f else int(d) for d, f in zip(known, flags, strict=True)]
        self.symbol_ends, self.id_ends = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.letters = take("<u4", first_new)
        self.rules, lengths = take("<u2", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take("<u4" if wide else "<u2", symbols)
        self.first_new, self.wide = first_new, bool(wide)
        self.length = np.ones(_TOP, np.int64)
        self.length[first_new : first_new + rules] = lengths
        self._flat = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All nonterminals' ids end to end, and where each begins; a terminal's own id stands at its own number."""
        if self._flat is None:
            starts = np.arange(_TOP, dtype=np.int64)
            lengths = self.length[self.first_new : self.first_new + len(self.rules)]
            offsets = _TOP + np.concatenate([[0], np.cumsum(lengths)])
            flat = np.empty(int(offsets[-1]), "<u4")
            flat[: self.first_new] = self.letters
            starts[self.first_new : self.first_new + len(self.rules)] = offsets[:-1]
            # A rule is spelled out once both its symbols are: level by level.
            level = np.zeros(_TOP, np.int64)
            for n, (a, b) in enumerate(self.rules.tolist(), self.first_new):
                level[n] = max(level[a], level[b]) + 1
            for depth in range(1, int(level.max(initial=0)) + 1):
                own = np.flatnonzero(level == depth)
                pairs = self.rules[own - self.first_new].reshape(-1)
                flat[gather(starts[own], self.length[own])] = flat[gather(starts[pairs], self.length[pairs])]
            self._flat = flat, starts
        return self._flat

    def decode(self, n: int) -> np.ndarray:
        return self._decoded(self.symbols[self.symbol_ends[n - 1] if n else 0 : self.symbol_ends[n]])

    def _decoded(self, symbols: np.ndarray) -> np.ndarray:
        if self.wide:
            return symbols
        flat, starts = self._expansions()
        return flat[gather(starts[symbols], self.length[symbols])]

    def __iter__(self) -> Iterator[np.ndarray]:
        """Each document's ids, decoded DECODE_DOCS documents at a time."""
        for a in range(0, len(self.doc_ids), DECODE_DOCS):
            ends = self.id_ends[a : a + DECODE_DOCS]
            begin = int(self.id_ends[a - 1]) if a else 0
            flat = self._decoded(self.symbols[self.symbol_ends[a - 1] if a else 0 : self.symbol_ends[a + len(ends) - 1]])
            yield from np.split(flat, ends[:-1] - begin)


def write_token_files(docs: DataFrame, path: str, end_id: int = 2) -> Table:
    """Documents' ids in ascending doc_id order, each closed by end_id; null doc_ids come first, null text is empty."""

    def encode(batches):
        from pyspark import TaskContext

        enc, end = encoder("word", path), np.array([end_id], np.uint32)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held, ids, ends, total = [], [], [], 0

        def flush():
            nonlocal shard, before, held, ids, ends, total
            file = write_file(held, np.array(ends, np.int64), np.concatenate(ids), before, end_id)
            row = pd.DataFrame([(part, shard, total, file)], columns=["part", "shard", "n_ids", "file"])
            shard, before, held, ids, ends, total = shard + 1, before + total, [], [], [], 0
            return row

        for b in batches:
            for doc_id, own in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), enc.ids_of_each(b["text"]), strict=True):
                total += len(own) + 1
                held.append(doc_id)
                ids += own, end
                ends.append(total)
                if total >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    ordered = keyed_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return Table(ordered.mapInPandas(encode, FILE_SCHEMA), "token-files")


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (and ids), all from the files. No files give no rows."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per write task
    bases, base = {}, 0
    for r in sizes:
        bases[r["part"]] = base
        base += r["n"]

    def decode(batches):
        for b in batches:
            for part, data in zip(b["part"], b["file"], strict=True):
                f = TokenFile(data)
                rows, start = [], bases[part] + f.before
                for doc_id, ids in zip(f.doc_ids, f, strict=True):
                    own = ids.astype("<u4").tobytes()
                    rows.append((doc_id, start, len(own) // 4, zlib.crc32(own)) + ((own,) if with_ids else ()))
                    start += len(own) // 4
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.select("part", "file").mapInPandas(decode, schema)
