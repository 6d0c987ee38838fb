"""Toxicity by the nearest labelled examples.

A bounded, documented sample of labelled rows (MAX_EXAMPLES, in the order of a hash of the id) is the index. A text's vector
has every word, weighted 1 + ln(tf) times idf and scaled to length one. Beside it stands a second part of the features
that tell the labels apart (words and word beginnings of 4 to 8 bytes, by the G statistic against chance over all features
tried; at most MAX_FEATURES), weighted and scaled alike; where a text has any, that part makes up TELLING of the squared
length. So no word is left out, and an equal text has the cosine 1. Words that no example has count for the length alone.
Every text is compared with the examples by the exact cosine of these vectors through a block-max inverted index: examples
lie in blocks, each frequent feature knows its largest weight in each block, the examples with the highest upper bounds are
read first, and of the others only those that can still enter the top K.

The K nearest vote with weight 1 / (1.05 - cosine), with the share of label 1 among all examples as a prior vote. Equal
example texts are one example with the share of label 1 among them, named by the lowest id. Votes become scores by isotonic
regression over the examples' own votes, each taken without itself. Texts that share no word with the examples (empty ones too) get the share of label 1 among such examples.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import Table as Numbers
from .hashing import Words, grown
from .shared import Table, id_remainder, keyed_texts, slices_of, text_of
from .words import plain_groups, plain_words

MAX_EXAMPLES = 16_000
MAX_FEATURES = 4096
K = 15
BLOCK = 64
WIDE_PART = 16
MANY_PART = 32
TOGETHER = 64
SCORED_TOGETHER = 512
COUNTED_TOGETHER = 60_000
SEEN = 5000
PRIOR_VOTES = 1.0
THRESHOLD = 0.3
TELLING = 0.8
_SIDES = (4, 5, 6, 7, 8)
_HELD = 400_000
_MARGIN = 1e-5


def features_of(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:n] for n in _SIDES if n < len(word))]


def choose_features(examples: DataFrame) -> dict[bytes, int]:
    """examples: text, toxic. The features that tell the labels apart, with their number of examples."""

    def count(batches):
        yes, no = Counter(), Counter()

        def flush():
            keys = list(yes.keys() | no.keys())
            rows = pd.DataFrame({"feature": keys, "yes": [yes[k] for k in keys], "no": [no[k] for k in keys]})
            yes.clear(), no.clear()
            return rows

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                own = {f for w in set(plain_words(text)) for f in features_of(w)}
                (yes if toxic else no).update(own)
                if len(yes) + len(no) > COUNTED_TOGETHER:
                    yield flush()
        yield flush()

    per = examples.mapInPandas(count, "feature binary, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    sizes = examples.groupBy("toxic").count().collect()
    pos = sum(r["count"] for r in sizes if r["toxic"])
    neg = sum(r["count"] for r in sizes if not r["toxic"])
    n = F.col("yes") + F.col("no")
    term = lambda seen, part: F.when(seen > 0, seen * F.log(seen / (n * part))).otherwise(0.0)
    share = pos / max(1, pos + neg)
    if not pos or not neg:
        return {}
    # What these examples' features would reach by chance, given how many are tried.
    counted_features = Table(per.where("yes + no > 1"), "features").read()
    least = 2 * math.log(100 * max(1, counted_features.count()))
    top = counted_features.withColumn("g", 2 * (term(F.col("yes"), share) + term(F.col("no"), 1 - share))).where(F.col("g") >= least)
    top = top.orderBy(F.desc("g"), "feature").limit(MAX_FEATURES)
    return {bytes(r["feature"]): r["yes"] + r["no"] for r in top.collect()}


def word_counts(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes of the examples' words, ascending, with their number of examples, and the number of examples."""

    def count(batches):
        for b in batches:
            for w in plain_groups(b["text"]):
                each = [np.unique(w.hash[x:y]) for x, y in zip(w.first, w.first[1:])]
                words, n = np.unique(np.concatenate(each), return_counts=True)
                yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    rows = examples.mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    words, n = np.array(rows["word"]).view(np.uint64), np.array(rows["n"])
    order = np.argsort(words)
    return words[order], n[order], examples.count()


class Vectors:
    """Texts as sparse unit vectors over the examples' words and, numbered after them, the telling features."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, telling: dict[bytes, int], examples: int):
        """words: hashes, ascending; counts, telling: their numbers of examples."""
        self.words = words
        self.telling = {f: len(words) + n for n, f in enumerate(sorted(telling))}
        idf = lambda n: np.log((1 + examples) / (1 + n)) + 1
        self.idf = idf(np.concatenate([counts, [telling[f] for f in self.telling]]).astype(float))
        self.strange = float(idf(0))
        self.forget()

    def forget(self) -> None:
        """The words met so far are numbered as they come, in `table`; place: the word's place in the vector, -1 if no example
        has it; tells: its telling features, where there are any."""
        self.table: Numbers | None = None
        self.place, self.tells = np.empty(0, np.int64), {}

    def __len__(self) -> int:
        return len(self.idf)

    def __getstate__(self):
        return self.__dict__ | {"table": None, "tells": {}, "place": self.place[:0]}

    def _numbers(self, w: Words) -> np.ndarray:
        if self.table is None:
            self.table = Numbers(_HELD)

        def learn(first: int, new: np.ndarray, at: np.ndarray) -> None:
            if not first:
                self.tells = {}
            self.place = grown(self.place, first + len(new))
            known = np.minimum(np.searchsorted(self.words, new), max(0, len(self.words) - 1))
            self.place[first : first + len(new)] = np.where(self.words[known] == new, known, -1) if len(self.words) else -1
            for n, word in enumerate(w.words(at), first) if self.telling else ():
                own = [self.telling[f] for f in features_of(word) if f in self.telling]
                if own:
                    self.tells[n] = own

        return self.table.numbered(w.hash, learn)

    def of_each(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for w in plain_groups(texts):
            numbers = self._numbers(w)
            for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
                yield self._vector(numbers[a:b])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.of_each([text]))

    def _vector(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, tf = np.unique(words, return_counts=True)
        place, weight = self.place[numbers], 1 + np.log(tf)
        strange = ((weight[place < 0] * self.strange) ** 2).sum()
        order = np.argsort(place)[int((place < 0).sum()) :]
        which = place[order]
        totals: Counter = Counter()
        for n in self.tells.keys() & numbers.tolist():
            count = int(tf[np.searchsorted(numbers, n)])
            for f in self.tells[n]:
                totals[f] += count
        plain = weight[order] * self.idf[which]
        if not totals:
            return which, plain / (math.sqrt((plain**2).sum() + strange) or 1)
        told = sorted(totals)
        side = (1 + np.log(np.array([totals[f] for f in told], float))) * self.idf[told]
        plain *= math.sqrt(1 - TELLING) / (math.sqrt((plain**2).sum() + strange) or 1)
        side *= math.sqrt(TELLING) / math.sqrt((side**2).sum())
        return np.concatenate([which, np.array(told, np.int64)]), np.concatenate([plain, side])


class BlockMaxIndex:
    """Exact top-K cosine over the examples' unit vectors.

    Features that more than a WIDE_PART-th of the examples have are wide, the others narrow. A query reads the postings of
    its narrow features whole. What its wide features can add to an example is bounded by their largest weights in the
    example's block, and by the lengths of both wide parts. The examples with the highest bounds are read first; the k-th
    best cosine there is what any other must reach, and only those whose bound does are read. Queries whose bounds leave
    many examples are read together, as one product of matrices. Cosines are summed in 64 bits for all that may be among
    the K; what is left out before is left out with a margin far above the rounding of 32 bits.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], features: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(v[0]) for v in vectors])
        cols = np.concatenate([v[0] for v in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        weight = np.concatenate([v[1] for v in vectors]).astype(np.float32) if vectors else np.empty(0, np.float32)
        order = np.argsort(cols, kind="stable")
        self.rows, self.weight, self.starts = rows[order], weight[order], np.append(0, np.cumsum(np.bincount(cols, minlength=features)))
        self.ready = False

    def __getstate__(self):
        """Postings only, in half the bytes; the rest is made where they arrive."""
        rows = self.rows.astype(np.uint16 if self.n <= 1 << 16 else np.int32)
        return {"n": self.n, "blocks": self.blocks, "rows": rows, "weight": self.weight.astype(np.float32), "starts": self.starts, "ready": False}

    def prepare(self) -> None:
        if self.ready:
            return
        features, sizes = len(self.starts) - 1, np.diff(self.starts)
        rows, weight = self.rows.astype(np.int32), self.weight.astype(np.float32)
        cols = np.repeat(np.arange(features, dtype=np.int32), sizes)
        wide = np.flatnonzero(sizes > max(1, self.n // WIDE_PART))
        self.place = np.full(features, -1, np.int32)
        self.place[wide] = np.arange(len(wide))
        self.table = np.zeros((self.n, len(wide)), np.float32)
        there = self.place[cols] >= 0
        self.table[rows[there], self.place[cols[there]]] = weight[there]
        del cols, there
        self.top = np.maximum.reduceat(self.table, np.arange(0, self.n, BLOCK), axis=0) if self.n else self.table
        self.length = np.sqrt(np.einsum("ij,ij->i", self.table, self.table))
        self.rows, self.weight, self.by_example = rows, weight, None
        self.ready = True

    def vector(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector of an example."""
        self.prepare()
        if self.by_example is None:
            cols = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
            order = np.argsort(self.rows, kind="stable")
            self.by_example = cols[order], self.weight[order], np.append(0, np.cumsum(np.bincount(self.rows, minlength=self.n)))
        cols, weight, at = self.by_example
        return cols[at[n] : at[n + 1]].astype(np.int64), weight[at[n] : at[n + 1]].astype(float)

    def _narrow(self, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What these features add to every example's cosine."""
        begins, ends = self.starts[which].tolist(), self.starts[which + 1].tolist()
        if not begins:
            return np.zeros(self.n)
        cuts = list(map(slice, begins, ends))
        adds = np.concatenate([self.weight[z] for z in cuts]) * np.repeat(weight, np.subtract(ends, begins))
        return np.bincount(np.concatenate([self.rows[z] for z in cuts]), adds, self.n)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest with a cosine above 0; ties go to the lower position."""
        return self.nearest_of_each([vector], k, [without])[0]

    def nearest_of_each(self, vectors: list, k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() for each vector; `without`: for each, the position that does not count (-1: none)."""
        out = [(np.empty(0, np.int64), np.empty(0))] * len(vectors)
        if not self.n:
            return out
        self.prepare()
        left, few = [], max(4 * k, self.n // MANY_PART)
        queries = np.zeros((len(vectors), self.table.shape[1]), np.float32)
        for query, (which, weight) in zip(queries, vectors, strict=True):
            place = self.place[which]
            query[place[place >= 0]] = weight[place >= 0]
        tops, lengths = queries @ self.top.T, np.sqrt((queries * queries).sum(axis=1))
        for n, ((which, weight), query) in enumerate(zip(vectors, queries, strict=True)):
            if not len(which):
                continue
            narrow = self.place[which] < 0
            sums = self._narrow(which[narrow], weight[narrow].astype(np.float32))
            if without is not None and without[n] >= 0:
                sums[without[n]] = -9.0
            bound = np.repeat(tops[n] + np.float32(_MARGIN), BLOCK)[: self.n]
            np.minimum(bound, lengths[n] * self.length + np.float32(_MARGIN), out=bound)
            bound += sums
            rows = np.argpartition(bound, -3 * k)[-3 * k :] if self.n > 3 * k else np.arange(self.n)
            least = self._least(sums[rows] + self.table[rows] @ query, k)
            rows = np.flatnonzero(bound >= max(least, 2 * _MARGIN))
            if len(rows) > few:
                left.append((n, sums, query))
                if len(left) == TOGETHER:
                    self._together(left, k, out)
                    left = []
            else:
                out[n] = self._best(rows, sums[rows] + self.table[rows] @ query, sums, query, k)
        if left:
            self._together(left, k, out)
        return out

    def _together(self, left: list, k: int, out: list) -> None:
        products = np.stack([q for _, _, q in left]) @ self.table.T
        for (n, sums, query), product in zip(left, products, strict=True):
            product += sums
            rows = np.flatnonzero(product >= max(self._least(product, k), _MARGIN))
            out[n] = self._best(rows, product[rows], sums, query, k)

    @staticmethod
    def _least(near: np.ndarray, k: int) -> float:
        """What the k-th best of these is at least; 0 where there are fewer."""
        return float(np.partition(near, len(near) - k)[len(near) - k]) - _MARGIN if len(near) >= k else 0.0

    def _best(self, rows: np.ndarray, near: np.ndarray, sums: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[near >= self._least(near, k) - _MARGIN]
        cosine = sums[rows] + (self.table[rows].astype(np.float64) * query).sum(axis=1)
        rows, cosine = rows[cosine > 0], cosine[cosine > 0]
        best = np.lexsort((rows, -np.round(cosine, 12)))[:k]
        return rows[best], cosine[best]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit (pooling adjacent violators)."""
    order = np.argsort(x, kind="stable")
    values, weights, ends = [], [], []
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        values.append(yi), weights.append(1.0), ends.append(xi)
        while len(values) > 1 and (values[-2] >= values[-1] or ends[-2] == ends[-1]):
            v, w, e = values.pop(), weights.pop(), ends.pop()
            values[-1] = (values[-1] * weights[-1] + v * w) / (weights[-1] + w)
            weights[-1] += w
            ends[-1] = e
    return np.array(ends), np.array(values)


class Model:
    """Votes of the nearest examples, calibrated."""

    def __init__(self, vectors: Vectors, ids: np.ndarray, toxic: np.ndarray, made: list[tuple[np.ndarray, np.ndarray]]):
        """The examples' ids, labels and vectors."""
        self.vectors = vectors
        # Examples with the same leading feature lie together, which keeps the blocks' bounds tight.
        lead = [(int(v[0][np.argmax(v[1])]) if len(v[0]) else 1 << 30) for v in made]
        order = np.lexsort((ids, toxic, lead))
        self.toxic, self.ids = toxic[order].astype(float), ids[order]
        self.index = BlockMaxIndex([made[n] for n in order], len(vectors))
        self.prior = float(self.toxic.mean()) if len(toxic) else 0.0
        bare = np.array([not len(made[n][0]) for n in order], bool)
        self.bare = float((self.toxic[bare].sum() + self.prior) / (bare.sum() + 1))
        self.full = np.flatnonzero(~bare)
        self.seen: dict[bytes, tuple] = {}
        self.ends, self.values = np.array([1.0]), np.array([self.prior])
        self.held = None

    def shared(self, spark: SparkSession):
        """The model as the tasks read it, sent once; the calibration's steps are not part of it and go with each job."""
        if self.held is None:
            self.held = spark.sparkContext.broadcast(self)
        return self.held

    def calibrate(self, own: np.ndarray) -> None:
        """own: the votes on the examples in `full`, each without itself."""
        ends, values = isotonic(own, self.toxic[self.full])
        # From where a step's votes begin to where they end its value holds; between two steps it rises in a line.
        known = np.sort(own)
        begins = known[np.searchsorted(known, np.append(-1.0, ends[:-1]), side="right")]
        self.ends, self.values = np.stack([begins, ends], 1).ravel(), np.repeat(values, 2)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "held": None}

    def votes(self, vectors: list, without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for at, cosine in self.index.nearest_of_each(vectors, K, without):
            weight = 1 / (1.05 - np.minimum(cosine, 1.0))
            out.append((float(((weight * self.toxic[at]).sum() + PRIOR_VOTES * self.prior) / (weight.sum() + PRIOR_VOTES)), at, cosine))
        return out

    @property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ends, self.values

    def scores(self, texts: list[str], steps: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list[int], list[float]]]:
        """Score, neighbours and cosines of each text; equal vectors are searched once."""
        vectors = list(self.vectors.of_each(texts))
        keys = [xxhash.xxh3_128_digest(w.tobytes() + x.tobytes()) if len(w) else b"" for w, x in vectors]
        if len(self.seen) > SEEN:
            self.seen.clear()
        seen, new = self.seen, {}
        for key, vector in zip(keys, vectors, strict=True):
            if key and key not in seen:
                new[key] = vector
        for key, (vote, at, cosine) in zip(new, self.votes(list(new.values())), strict=True):
            seen[key] = vote, self.ids[at].tolist(), cosine.tolist()
        return [(float(np.interp(seen[key][0], *steps)), *seen[key][1:]) if key else (self.bare, [], []) for key in keys]


def fit_model(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Learns from documents that have a label; of more than max_examples the first by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).join(known, "doc_id").distinct()
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "id long, toxic int")
    texts = keyed_texts(docs).where("doc_id is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    examples = Table(texts, "examples")
    texts = examples.read()
    words, counts, n = word_counts(texts)
    vectors = Vectors(words, counts, choose_features(texts), n)
    held = spark.sparkContext.broadcast(vectors)

    def make(batches):
        for b in batches:
            made = list(held.value.of_each(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "which": [w.astype("<i4").tobytes() for w, _ in made], "weight": [x.tobytes() for _, x in made]})

    # Equal texts are one example: the lowest id, the share of label 1.
    each = texts.mapInPandas(make, "doc_id long, toxic int, which binary, weight binary").groupBy("which", "weight")
    rows = each.agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic")).toArrow()
    examples.drop()
    made = [(np.frombuffer(w, "<i4"), np.frombuffer(x)) for w, x in zip(rows["which"].to_pylist(), rows["weight"].to_pylist(), strict=True)]
    model = Model(vectors, np.array(rows["doc_id"].to_pylist(), np.int64), np.array(rows["toxic"].to_pylist(), float), made)
    del rows, made
    held.destroy()
    if len(model.full):
        ready = model.shared(spark)

        def votes(batches):
            for b in batches:
                for a in range(0, len(b), SCORED_TOGETHER):
                    own = b["n"].iloc[a : a + SCORED_TOGETHER].tolist()
                    found = ready.value.votes([ready.value.index.vector(n) for n in own], own)
                    yield pd.DataFrame({"n": own, "vote": [f[0] for f in found]})
            ready.value.index.by_example = None

        places = spark.createDataFrame(pd.DataFrame({"n": model.full})).repartition(slices_of(len(model.full), 500, 1))
        own = places.mapInPandas(votes, "n long, vote double").toArrow()
        order = np.argsort(np.array(own["n"]))
        model.calibrate(np.array(own["vote"])[order])
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, neighbours, cosines.

    Null text counts as empty; texts without a word of the examples get the share of label 1 among such examples. A null
    doc_id stays null, repeated rows each get a row, ties of cosines go to the lower position. An empty table gives no
    rows. Columns other than doc_id and text are not read. A labelled text is its own neighbour.
    """
    held, steps = model.shared(docs.sparkSession), model.steps

    def score(batches):
        for b in batches:
            for a in range(0, len(b), SCORED_TOGETHER):
                own = b.iloc[a : a + SCORED_TOGETHER]
                rows = held.value.scores(own["text"].tolist(), steps)
                yield pd.DataFrame({
                    "doc_id": own["doc_id"].astype("Int64"), "score": [r[0] for r in rows], "predicted": [int(r[0] >= THRESHOLD) for r in rows],
                    "neighbours": [r[1] for r in rows], "cosines": [r[2] for r in rows],
                })

    return keyed_texts(docs).mapInPandas(score, "doc_id long, score double, predicted int, neighbours array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. Each row is judged by its own text (null: empty)."""
    held, steps = model.shared(docs.sparkSession), model.steps

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        parts = (text.iloc[a : a + SCORED_TOGETHER].tolist() for a in range(0, len(text), SCORED_TOGETHER))
        return pd.Series([r[0] for part in parts for r in held.value.scores(part, steps)], dtype=float)

    return docs.where(score(text_of(docs)) < THRESHOLD)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows whose id remainder is not 2, score every row. Rows without an id are not learned from: held out."""
    model = fit_model(docs.where(id_remainder(docs["doc_id"], 4) != 2), labels)
    scored = score_toxicity(docs, model)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "neighbours", "cosines")
