"""Exact dedup against a history held in a sharded minimal perfect hash.

The history is a set of distinct SHA-256 digests. It is cut into shards by the digest's leading bits; each shard holds a
minimal perfect hash (levels of bit arrays with ranks), and slot i of the shard holds the full digest that hashes to i,
the locator (doc_id) of its winner and the number of its rows. A lookup hashes a digest to a slot and compares all 32
bytes: equal means a repeat of the history, anything else means a nonmember. Nonmembers are grouped among themselves.

Shards hold about SHARD_KEYS digests at any corpus size. Digests are aggregated to one row each (map side first) before
they travel to their shard, so a text that fills a third of the table is one row there; the way back to its rows is a
sort-merge join whose large side adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, keyed_texts, mix64, slices_of

SHARD_KEYS = 50_000
GAMMA = 2.0
SHARD_SCHEMA = "shard int, sizes array<long>, bits binary, digests binary, winners binary, counts binary"
_GOLDEN = 0x9E3779B97F4A7C15


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((_GOLDEN * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix64(words[:, 1] ^ salt) % np.uint64(size)


def build_shard(digests: list[bytes], winners: np.ndarray, counts: np.ndarray) -> dict:
    """Levels of bit arrays: a digest alone at its bit stays there, those that collide go to the next level."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    left, sizes, levels, slot_of, base = np.arange(len(words)), [], [], np.empty(len(words), np.int64), 0
    while len(left):
        size = int(GAMMA * len(left)) // 64 * 64 + 64
        at = _positions(words[left], len(sizes), size).astype(np.int64)
        bit = np.bincount(at, minlength=size) == 1
        alone = bit[at]
        slot_of[left[alone]] = base + np.cumsum(bit)[at[alone]] - 1
        base += int(bit.sum())
        sizes.append(size)
        levels.append(np.packbits(bit, bitorder="little"))
        left = left[~alone]
    order = np.empty(len(words), np.int64)
    order[slot_of] = np.arange(len(words))
    return {
        "sizes": [int(s) for s in sizes],
        "bits": b"".join(x.tobytes() for x in levels),
        "digests": words[order].tobytes(),
        "winners": np.asarray(winners, "<i8")[order].tobytes(),
        "counts": np.asarray(counts, "<i8")[order].tobytes(),
    }


def lookup(shard: dict, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each digest: is it a member (all bytes equal), its winner, its rows in the history."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    slot, open_, base, at_byte = np.full(len(words), -1, np.int64), np.arange(len(words)), 0, 0
    for level, size in enumerate(shard["sizes"]):
        bit = np.unpackbits(np.frombuffer(shard["bits"], np.uint8, size // 8, at_byte), bitorder="little")
        rank = np.cumsum(bit, dtype=np.int64)
        at = _positions(words[open_], level, size).astype(np.int64)
        hit = bit[at] == 1
        slot[open_[hit]] = base + rank[at[hit]] - 1
        base, at_byte, open_ = base + int(rank[-1]), at_byte + size // 8, open_[~hit]
    held = np.frombuffer(shard["digests"], dtype="<u8").reshape(-1, 4)
    some = slot >= 0
    member = np.zeros(len(words), bool)
    member[some] = (held[slot[some]] == words[some]).all(axis=1)
    winner, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    winner[member] = np.frombuffer(shard["winners"], "<i8")[slot[member]]
    count[member] = np.frombuffer(shard["counts"], "<i8")[slot[member]]
    return member, winner, count


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the unchanged text in UTF-8."""
    texts = keyed_texts(docs)
    return texts.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def _with_shard(distinct: DataFrame, shards: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return distinct.withColumn("shard", (lead % shards).cast("int"))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """distinct: digest, winner, n. One row per shard."""

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        made = build_shard(rows["digest"].tolist(), rows["winner"].to_numpy(), rows["n"].to_numpy())
        return pd.DataFrame([{"shard": key[0]} | made])

    return _with_shard(distinct, shards).groupBy("shard").applyInPandas(build, SHARD_SCHEMA)


def probe_index(index: DataFrame, distinct: DataFrame, shards: int) -> DataFrame:
    """distinct: digest, winner, n of a batch. Adds member, old_winner, old_n."""

    def probe(key, slots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        member = np.zeros(len(rows), bool)
        winner = count = np.zeros(len(rows), np.int64)
        if len(slots) and len(rows):
            member, winner, count = lookup(slots.iloc[0].to_dict(), rows["digest"].tolist())
        out = rows[["digest", "winner", "n"]].copy()
        return out.assign(member=member, old_winner=winner, old_n=count)

    schema = "digest binary, winner long, n long, member boolean, old_winner long, old_n long"
    return index.groupBy("shard").cogroup(_with_shard(distinct, shards).groupBy("shard")).applyInPandas(probe, schema)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: documents seen before (doc_id, text); by default the rows of docs below the middle of its doc_id range, so
    that the rest is the new batch. Rows of both are returned when it is left out, rows of docs alone otherwise.

    Texts are equal when identical; of equal texts the largest doc_id stays. Null text counts as empty, and empty texts are
    equal to each other. Repeated doc_ids with equal text each get a row, all marked as kept when their id is. A null
    doc_id is never kept if its group has another; alone it gives keep_id null and kept false. Empty input gives no rows.
    """
    if history is None:
        ends = docs.agg(F.min(docs["doc_id"]).alias("a"), F.max(docs["doc_id"]).alias("b")).first()
        middle = 0 if ends["a"] is None else (ends["a"] + ends["b"]) // 2
        every = digests_of(docs).withColumn("old", F.coalesce(F.col("doc_id") <= middle, F.lit(False)))
    else:
        every = digests_of(history).withColumn("old", F.lit(True)).union(digests_of(docs).withColumn("old", F.lit(False)))
    rows = Table(every, "digests")
    both = Table(
        rows.read().groupBy("digest", "old").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")), "distinct"
    )
    none = -(1 << 63)
    side = lambda old: both.read().where(F.col("old") == old).select("digest", F.coalesce("winner", F.lit(none)).alias("winner"), "n")
    past, batch = side(True), side(False)
    shards = slices_of(past.count(), SHARD_KEYS)
    index = Table(build_index(past, shards), "mph")
    found = Table(probe_index(index.read(), batch, shards), "probed")
    repeats = found.read().where("member").select(
        "digest", F.greatest("winner", "old_winner").alias("winner"), (F.col("n") + F.col("old_n")).alias("n")
    )
    fresh = found.read().where("not member").groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
    # What the batch does not repeat keeps the winner of its slot.
    quiet = past.join(repeats.select("digest"), "digest", "left_anti")
    winners = repeats.unionByName(fresh).unionByName(quiet)
    wanted = rows.read() if history is None else rows.read().where("not old")
    out = wanted.join(winners, "digest").select(
        "doc_id",
        F.when(F.col("winner") != none, F.col("winner")).alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("winner"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return out


def keep_winners(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one for each distinct text: that with the largest doc_id (of repeated rows any one).

    Null text counts as empty. A text that only rows without an id have keeps one of them. Rows that share an id but not
    the text are told apart by the text. An empty table stays empty; columns of any name are carried through.
    """
    named = exact_dedup(docs).select("keep_id", "text_sha256").distinct()
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    tagged = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), sha.alias("sha"))
    kept = tagged.join(named, (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    # Only repeated rows of one id and text are left to tell apart, and those without an id.
    return kept.dropDuplicates(["id", "sha"]).select("row.*")
