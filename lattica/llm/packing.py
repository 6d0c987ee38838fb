"""Bulk-synchronous best-fit packing of tokenised documents into sequences of a fixed capacity.

Every document is cut into pieces of the capacity, of which the first may be shorter. Pieces and gaps are kept range-sorted by size. A superstep takes
the longest pieces still open and sweeps the sorted gaps upwards for their successors (the least gap that holds them);
where several pieces want one gap, ranks decide: the r-th piece of a length takes the r-th such gap. Filled gaps shrink,
move to their new place in the order, and the next superstep begins; what found no gap opens new sequences.

Sizes are integers up to the capacity, so the sorted order is a run-length table of at most `capacity` rows whatever the
corpus holds. The supersteps therefore run on runs of equal sizes (the driver sees counts, never pieces) and yield rules
"pieces of length l with ranks a..b go to sequences s.. at offset o". What grows with the corpus is distributed: encoding,
counting, ranking (each length is cut into slices, so that a length that a third of all pieces have is no single task's)
and placing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Table, keyed_texts, slices_of
from .tokens import encoder

SLICE_ROWS = 100_000


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        enc, end = encoder("byte", path), np.array([end_id], np.uint32)
        step = 4 * capacity
        for b in batches:
            out = []
            for doc_id, own in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), enc.ids_of_each(b["text"]), strict=True):
                ids = np.concatenate([own, end]).tobytes()
                first = len(ids) % step or step
                for n, end_at in enumerate(range(first, len(ids) + 1, step)):
                    at = max(0, end_at - step)
                    part = ids[at:end_at]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return keyed_texts(docs).mapInPandas(cut, schema)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first rank, number, first sequence, offset) from the number of pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs (first sequence, how many)
    rules, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        sweep = length
        while left and sweep <= capacity:
            if not gaps.get(sweep):
                sweep += 1
                continue
            first, n = gaps[sweep].pop()
            take = min(n, left)
            rules.append((length, rank, take, first, capacity - sweep))
            left, rank = left - take, rank + take
            if take < n:
                gaps[sweep].append((first + take, n - take))
            gaps[sweep - length].append((first, take))
            sweep = sweep - length if sweep - length >= length else sweep
        each = capacity // length
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                for j in range(k):
                    rules.append((length, rank, n, opened, j * length))
                    rank += n
                gaps[capacity - k * length].append((opened, n))
                opened += n
    return rules


def best_fit_pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null text counts as empty: a document of the end id alone. Repeated rows are packed once each. A null doc_id stays
    null. Other columns are not read. An empty table gives no rows.
    """
    cut = Table(pieces_of(docs, path, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.read().groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules = sorted(supersteps(counts, capacity))
    slices = slices_of(sum(counts.values()), SLICE_ROWS, 1)
    sliced = cut.read().withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = sliced.withColumn("within", within).join(before, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "slice")
    table = np.array(rules, np.int64).reshape(-1, 5)
    bounds = table[:, 0] << 48 | table[:, 1]

    def place(batches):
        for b in batches:
            at = np.searchsorted(bounds, b["length"].to_numpy() << 48 | b["rank"].to_numpy(), side="right") - 1
            own = table[at]
            sequence = own[:, 3] + b["rank"].to_numpy() - own[:, 1]
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=own[:, 4])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ranked.select(*columns, "rank").mapInPandas(place, schema + ", sequence_id long, offset long")
