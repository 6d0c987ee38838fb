"""Language identification by language-bitmask n-gram filters.

One Bloom filter whose slots hold a bit per language (planes of 64 languages): inserting an n-gram sets its languages' bits
in k slots, and one probe - the AND of k slots - returns every language that contains the n-gram. A text's bits are summed
per language (bit-sliced popcounts), each sum is corrected for the false positives that its plane's fill predicts, and the
largest wins.

n-grams are windows of four bytes of the lower-cased text with signs as spaces, each named by its own bytes. All training
texts are counted. An n-gram belongs to the languages whose rate of it is at least SHARE of the highest and at least
LEAST_RATE. Rates of a language add up to 1, so it has at most 1 / LEAST_RATE n-grams, and its plane of the filter is at
most 40 % full, at any corpus size. Slots are combined by the cluster; the driver gets at most 2^SLOT_BITS of them for each
64 languages.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, id_remainder, mix64, text_of

SLOT_BITS = 22
PROBES = 2
SHARE = 0.5
LEAST_RATE = 2.0**-20
MAX_LANGUAGES = 1024
FLUSH_BYTES = 1 << 23
_PLAIN_LETTER = re.compile("[A-Za-z]")
_KEEP = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def gram_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts end to end, four bytes as a number each, and how many each text has."""
    parts = [b"   " + t.lower().encode("utf-8", "replace").translate(_KEEP) + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts) + b"   ", np.uint8)
    wide = raw.astype(np.uint32)
    window = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    space = (raw == 32).astype(np.uint8)
    valid = space[:-3] + space[1:-2] + space[2:-1] + space[3:] <= 1
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    per = np.add.reduceat(valid.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    return window[valid], per


def _chunks(frame: pd.DataFrame):
    """Rows in chunks of bounded bytes; a longer text is a chunk of its own."""
    held, size = [], 0
    for n, t in enumerate(frame["text"]):
        held.append(n)
        size += len(t)
        if size >= FLUSH_BYTES:
            yield frame.iloc[held]
            held, size = [], 0
    if held:
        yield frame.iloc[held]


def count_grams(docs: DataFrame, languages: list[str]) -> DataFrame:
    """language (index), name, n over all rows of docs (text, lang)."""

    def count(batches):
        index = {x: i for i, x in enumerate(languages)}
        for b in batches:
            for lang, own in b.groupby("lang"):
                for chunk in _chunks(own):
                    names, n = np.unique(gram_names(chunk["text"].tolist())[0], return_counts=True)
                    yield pd.DataFrame({"language": np.full(len(names), index[lang], np.int32), "name": names.astype(np.int64), "n": n})

    each = docs.mapInPandas(count, "language int, name long, n long")
    return each.groupBy("language", "name").agg(F.sum("n").alias("n"))


def slots_of(names: np.ndarray, slot_bits: int = SLOT_BITS) -> list[np.ndarray]:
    mixed = mix64(names.astype(np.uint64) + np.uint64(1))
    return [((mixed >> np.uint64(31 * j)) & np.uint64((1 << slot_bits) - 1)).astype(np.int64) for j in range(PROBES)]


def member_grams(counts: DataFrame) -> DataFrame:
    """name, language: the n-grams that a language contains. counts: language, name, n."""
    sizes = counts.groupBy("language").agg(F.sum("n").alias("all"))
    rates = counts.join(F.broadcast(sizes), "language").withColumn("rate", F.col("n") / F.col("all"))  # a row a language
    best = rates.groupBy("name").agg(F.max("rate").alias("best"))
    frequent = rates.where(F.col("rate") >= LEAST_RATE)
    return frequent.join(best, "name").where(F.col("rate") >= SHARE * F.col("best")).select("name", "language")


def filter_slots(members: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """plane, slot, bits: the filter's slots that are not empty, each with the bits of its languages."""

    def place(batches):
        for b in batches:
            language = b["language"].to_numpy()
            bits = (np.uint64(1) << (language % 64).astype(np.uint64)).view(np.int64)
            for s in slots_of(b["name"].to_numpy(), slot_bits):
                yield pd.DataFrame({"plane": (language // 64).astype(np.int32), "slot": s.astype(np.int32), "bits": bits})

    return members.mapInPandas(place, "plane int, slot int, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits"))


def build_filter(slots: pd.DataFrame, languages: int, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """Planes x slots; a plane's type is the narrowest that holds its languages."""
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if languages <= bits or bits == 64)
    planes = np.zeros((max(1, -(-languages // 64)), 1 << slot_bits), kind)
    planes[slots["plane"], slots["slot"]] = slots["bits"].to_numpy().view(np.uint64).astype(kind)
    return planes


def filter_fill(planes: np.ndarray, languages: int) -> np.ndarray:
    """For each language the part of its plane that is set."""
    return np.array([((planes[i // 64] >> planes.dtype.type(i % 64)) & planes.dtype.type(1)).mean() for i in range(languages)])


def filter_scores(planes: np.ndarray, fill: np.ndarray, texts: list[str]) -> np.ndarray:
    """Texts x languages: the n-grams that a language contains, corrected for false positives."""
    names, per = gram_names(texts)
    out = np.zeros((len(texts), len(fill)))
    if not len(names):
        return out
    slots, full = slots_of(names, planes.shape[1].bit_length() - 1), per > 0
    starts = (np.cumsum(per) - per)[full]
    wrong = fill**PROBES
    for plane in range(len(planes)):
        mask = planes[plane][slots[0]]
        for s in slots[1:]:
            mask = mask & planes[plane][s]
        for bit in range(min(64, len(fill) - 64 * plane)):
            hits = (mask >> mask.dtype.type(bit)) & mask.dtype.type(1)
            out[full, 64 * plane + bit] = np.add.reduceat(hits, starts, dtype=np.int64)
    return np.clip((out - per[:, None] * wrong) / (1 - wrong), 0, None)


def identify_languages(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    train: text, lang; null languages and texts without a letter are left out. score is the winner's part of all
    languages' corrected counts; ties go to the language first in the alphabet. Null text or text without a letter is
    `und` with score 0; so is every text when nothing could be learnt. A text with letters but no n-gram that any language
    contains gets the language with most training texts, with that language's part of them. Repeated rows each get a row; a null
    doc_id stays null; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    known = train.where("lang is not null and text is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = list(sizes)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = "doc_id long, lang_pred string, score double"
    if not languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    counts = Table(count_grams(known, languages), "grams").read()
    planes = build_filter(filter_slots(member_grams(counts)).toPandas(), len(languages))
    fill = filter_fill(planes, len(languages))
    held, usual = sc.broadcast(planes), max(sizes, key=lambda x: sizes[x])
    usual_part = sizes[usual] / sum(sizes.values())

    def predict(batches):
        for b in batches:
            for chunk in _chunks(b):
                texts = chunk["text"].tolist()
                scores = filter_scores(held.value, fill, texts)
                total, won = scores.sum(axis=1), scores.argmax(axis=1)
                letter = np.array([_PLAIN_LETTER.search(t) is not None or any(map(str.isalpha, t)) for t in texts], bool)
                lang = np.array(languages, object)[won]
                score = scores[np.arange(len(texts)), won] / np.where(total > 0, total, 1)
                lang, score = np.where(total > 0, lang, usual), np.where(total > 0, score, usual_part)
                yield pd.DataFrame({"doc_id": chunk["doc_id"], "lang_pred": np.where(letter, lang, "und"), "score": np.where(letter, score, 0.0)})

    return rows.mapInPandas(predict, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose id remainder is not 2, predict every row. Rows without an id are not learned from: held out."""
    out = identify_languages(docs, docs.where(id_remainder(docs["doc_id"], 4) != 2))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score")
