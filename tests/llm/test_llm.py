"""The operators on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import contextlib
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import attention_lm, decontamination, exact_dedup, language_id, line_dedup, ngram_join, packing, pii, registry, token_files, toxicity
from lattica.llm.components import connected_components
from lattica.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = registry.vocabulary_file("byte_bpe_50k.json"), registry.vocabulary_file("word_bpe_49k.json")


def table(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, t, la in zip(ids, texts, langs, strict=True)], SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


LONG = " ".join(words(30_000, 9))
ODD = [None, "", "  \n ", "a", "a", LONG, LONG, "don't  stop\t<|endoftext|> é́ß ²", "日本語 テキスト"]


def clashing(df):
    """Extra columns with the names that operators use inside."""
    for c in ("digest", "th", "cid", "n", "root", "text_sha256", "score", "component_id", "winner", "ids"):
        df = df.withColumn(c, F.lit("x"))
    return df


# 1


def test_exact_dedup(spark):
    ids = [5, 1, 2, 3, 7, 8, 9, 10, 11]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(clashing(table(spark, ODD, ids))).collect()}
    groups = collections.defaultdict(list)
    for i, t in zip(ids, ODD, strict=True):
        groups[t or ""].append(i)
    for t, own in groups.items():
        for i in own:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_with_null_ids_repeats_and_history(spark):
    docs = table(spark, ["x", "x", "y", "y", "z"], [None, 4, None, None, 4])
    got = sorted(((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == [(-1, 4, 2, False), (-1, None, 2, False), (-1, None, 2, False), (4, 4, 1, True), (4, 4, 2, True)]
    batch, old = table(spark, ["x", "q"], [1, 2]), table(spark, ["x", "x"], [10, 11])
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(batch, old).collect()}
    assert got == {1: (11, False), 2: (2, True)}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    kept = exact_dedup.keep_winners(table(spark, ["x", "x", "y", "y"], [3, 3, None, None]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and kept.count() == 2


def test_winners_are_rows_and_not_ids(spark):
    rows = [(3, "x"), (3, "y"), (5, "z"), (4, "x"), (3, "y"), (None, "z"), (None, "q"), (None, "q"), (7, None), (6, "")]
    kept = exact_dedup.keep_winners(clashing(table(spark, [t for _, t in rows], [i for i, _ in rows])))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(4, "x"), (3, "y"), (5, "z"), (None, "q"), (7, None)], key=str)


def test_decontamination_judges_rows_and_not_ids(spark):
    item = " ".join(words(30, 5, 4000))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"a b {item} c"), (None, "clean one"), (4, item), (4, "clean two"), (5, ""), (6, None)]
    left = decontamination.decontaminate(clashing(table(spark, [t for _, t in rows], [i for i, _ in rows])), benchmark)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(None, "clean one"), (4, "clean two"), (5, ""), (6, None)], key=str)
    assert decontamination.decontaminate(table(spark, []), benchmark).count() == 0


def test_hash_is_minimal_and_perfect_and_rejects_strangers():
    own = [hashlib.sha256(str(n).encode()).digest() for n in range(3000)]
    shard = exact_dedup.build_shard(own, np.arange(3000), np.ones(3000))
    member, winner, _ = exact_dedup.lookup(shard, own)
    assert member.all() and (winner == np.arange(3000)).all() and len(shard["digests"]) == 3000 * 32
    assert not exact_dedup.lookup(shard, [hashlib.sha256(b"no" + d).digest() for d in own])[0].any()


# 2


def test_decontamination_by_brute_force(spark):
    r = random.Random(4)
    items = [words(r.randint(5, 40), n, 5000) for n in range(20)] + [[], words(12, 3, 5000)]
    docs = []
    for n in range(60):
        doc = words(r.randint(0, 150), 1000 + n, 5000)
        if n % 2:
            passage = list(items[r.randrange(20)])
            for _ in range(r.randint(0, int(0.3 * len(passage)))):
                at, kind = r.randrange(len(passage)), r.randrange(3)
                passage[at : at + 1] = [["zz"], [], [passage[at], "yy"]][kind]
                passage = passage or ["zz"]
            at = r.randint(0, len(doc))
            doc = doc[:at] + passage + doc[at:]
        docs.append(doc)
    want = {}
    for n, doc in enumerate(docs):
        for m, item in enumerate(items):
            column = list(range(len(item) + 1))
            best = column[-1]
            for w in doc:
                new = [0]
                for i, p in enumerate(item, 1):
                    new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p != w)))
                column, best = new, min(best, new[-1])
            if item and best <= int(0.2 * len(item)):
                want[n, m] = best
    table_docs = table(spark, [", ".join(d).title() for d in docs])
    bench = spark.createDataFrame([(m, " ".join(i)) for m, i in enumerate(items)] + [(99, None)], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontamination.contamination_matches(table_docs, bench).collect()}
    assert found == want and len(want) > 10
    clean = {x["doc_id"] for x in decontamination.decontaminate(table_docs, bench).collect()}
    assert clean == set(range(60)) - {n for n, _ in want}


def test_decontamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    marks = decontamination.mark_contaminated(clashing(table(spark, [*ODD, "One, two; THREE four five six!"])), bench)
    assert [r["doc_id"] for r in marks.where("contaminated").collect()] == [9] and marks.count() == 10
    assert decontamination.mark_contaminated(table(spark, []), bench).count() == 0
    assert not decontamination.mark_contaminated(table(spark, ["a b"]), bench.limit(0)).first()["contaminated"]


# 3


def test_base_score_and_model(spark):
    texts = [" ".join(words(r, r, 50)) + " The End" for r in range(1, 60)] + [None, "", "new words only", "A a"]
    docs = clashing(table(spark, texts))
    got = {r["doc_id"]: r for r in attention_lm.score_texts(docs, WORD).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    split = [(t or "").lower().split() + ["\n"] for t in texts]
    counts = collections.Counter(w for s, h in zip(split, held, strict=True) if not h for w in s)
    n, v = sum(counts.values()), len(counts)
    for i, s in enumerate(split):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["held_out"] == held[i]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(s), sum(counts[w] > 0 for w in s), n)
        assert got[i]["score"] < 0
    assert attention_lm.score_texts(table(spark, []), WORD).count() == 0


def test_both_scores_of_a_row_are_its_own(spark):
    texts = [" ".join(words(40, n, 60)) for n in range(30)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, texts[3]), (None, texts[4]), (None, texts[3]), (5, texts[6]), (5, texts[5]), (None, None), (None, "")]
    got = attention_lm.score_texts(clashing(table(spark, [t for _, t in rows], [i for i, _ in rows])), WORD).collect()
    assert len(got) == len(rows)
    alone = {(x["n_tokens"], round(x["base_score"], 6)): x["score"] for x in got if x["doc_id"] is not None}
    per = collections.Counter((x["doc_id"], round(x["base_score"], 6)) for x in got)
    assert all(x["held_out"] for x in got if x["doc_id"] is None) and sum(n for (i, _), n in per.items() if i is None) == 5
    for x in got:
        if x["n_tokens"] > 1:
            assert x["score"] == pytest.approx(alone[x["n_tokens"], round(x["base_score"], 6)], rel=1e-6)
    assert attention_lm.score_texts(table(spark, []), WORD).count() == 0


def test_model_is_a_distribution_and_its_gradient_is_right():
    r = np.random.default_rng(0)
    bigram = np.log(r.dirichlet(np.ones(attention_lm.CLASSES), attention_lm.CLASSES + 1)).astype(np.float32)
    w = attention_lm.Weights({k: x.astype(np.float64) for k, x in attention_lm.Weights.fresh().items()})
    docs = [r.integers(0, attention_lm.CLASSES, n) for n in (3, 20, 9)]
    inputs, targets, _, first = attention_lm.blocks_of(docs)
    before, t = attention_lm.previous(inputs), targets.reshape(-1)

    def loss():
        logits = attention_lm.forward(w, bigram, inputs, before, first)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return -np.log(p[t >= 0, t[t >= 0]]).sum(), p

    _, p = loss()
    _, held = attention_lm.forward(w, bigram, inputs, before, first, keep=True)
    grad = p.copy()
    grad[np.arange(len(t)), np.maximum(t, 0)] -= 1
    grad[t < 0] = 0
    g = attention_lm.backward(w, inputs, held, grad)
    for name in w:
        at = tuple(r.integers(0, n) for n in w[name].shape)
        if name in "es":
            at = (int(docs[1][2]), at[1])
        old, eps = w[name][at], 1e-5
        w[name][at] = old + eps
        up = loss()[0]
        w[name][at] = old - eps
        down = loss()[0]
        w[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=1e-4), name
    # An id must not see what comes after it.
    changed = [d.copy() for d in docs]
    changed[1][12] = (changed[1][12] + 1) % attention_lm.CLASSES
    a = attention_lm.forward(w, bigram, inputs, before, first)
    inputs2, _, _, _ = attention_lm.blocks_of(changed)
    b = attention_lm.forward(w, bigram, inputs2, attention_lm.previous(inputs2), first)
    at = 8 + 12
    assert np.allclose(a[: at + 1], b[: at + 1]) and not np.allclose(a[at + 1], b[at + 1])


def test_attention_is_fitted_on_all_training_documents(spark, monkeypatch):
    texts = [" ".join(words(60, n, 50)) for n in range(120)]
    rows = [(n, bytes(np.append(ids_of("word", WORD, t), 49407).astype("<u2").tobytes())) for n, t in enumerate(texts)]
    docs, total = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3), sum(len(x) // 2 for _, x in rows)
    monkeypatch.setattr(attention_lm, "SAMPLE_IDS", total // 4)
    model = attention_lm.fit(docs)
    assert model.trained == total
    sample = attention_lm.first_documents(docs, total, np.arange(49408))
    whole = {x for _, x in rows}
    assert 0 < sum(map(len, sample)) < total // 2 and all(x.astype("<u2").tobytes() in whole for x in sample)
    start = attention_lm.train([model.classes[x] for x in sample], model.bigram)
    assert not np.allclose(start["u"], model.weights["u"], atol=1e-4)
    # Averaged over two equal tasks, the weights are those of one.
    row = spark.createDataFrame(rows[:1], "doc_id long, ids binary")
    size = len(rows[0][1]) // 2
    one, n = attention_lm.train_on_all(row, model.classes, model.bigram, start, size)
    two, m = attention_lm.train_on_all(row.unionAll(row), model.classes, model.bigram, start, 2 * size)
    assert (n, m) == (size, 2 * size) and all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_attention_learns_from_every_block_of_a_document(spark):
    r = np.random.default_rng(4)
    classes = r.integers(0, attention_lm.CLASSES, 49408).astype(np.int32)
    bigram = np.log(r.dirichlet(np.ones(attention_lm.CLASSES), attention_lm.CLASSES + 1)).astype(np.float32)
    ids, start = np.append(r.integers(0, 49000, 90), 49407), attention_lm.Weights.fresh()
    row = spark.createDataFrame([(1, bytes(ids.astype("<u2").tobytes()))], "doc_id long, ids binary")
    got, _ = attention_lm.train_on_all(row, classes, bigram, start, len(ids))
    want = attention_lm.Weights({n: x.copy() for n, x in start.items()})
    # Twelve blocks are one batch: its gradient holds the targets of all of them.
    inputs, targets, _, depth = attention_lm.blocks_of([ids], 49408)
    named = np.append(classes, attention_lm.CLASSES).astype(np.int32)
    now, t = named[inputs], targets.reshape(-1)
    p, held = attention_lm.forward(want, bigram, now, named[attention_lm.previous(inputs)], depth, keep=True)
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(t)), named[np.maximum(t, 0)]] -= 1
    p[t < 0] = 0
    g = attention_lm.backward(want, now, held, p / np.float32(len(ids)))
    attention_lm.Adam(want).step(want, g, attention_lm.PASS_RATE)
    # Which way each output weight goes, where the gradient is well above rounding.
    sure = np.abs(g["u"]) > 1e-5
    assert sure.mean() > 0.5 and np.allclose(got["u"][sure], want["u"][sure], atol=2e-4)


def test_stages_after_the_scan_give_back_what_it_took(spark):
    """In a worker that Spark uses again: neither the scan's encoder nor freed blocks stay beside what the next stage holds."""

    class Docs:
        def mapInPandas(self, f, schema):
            self.task = f
            raise StopIteration

    def held() -> float:
        lines = open("/proc/self/smaps_rollup").read().splitlines()
        return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024

    docs = Docs()
    with contextlib.suppress(StopIteration):
        attention_lm.company_counts(docs)

    def work(batches):
        for _ in batches:
            encoder("word", WORD)
            blocks = [bytes(2000) for _ in range(150_000)]
            last = blocks.pop()  # the heap's end is in use, so free() alone returns nothing
            del blocks
            before = held()
            list(docs.task([pd.DataFrame({"ids": [np.array([1, 49407], "<u2").tobytes()]})]))
            yield pd.DataFrame({"kept": [encoder.cache_info().currsize], "given": [before - held()], "size": [len(last)]})

    got = spark.range(1).coalesce(1).mapInPandas(work, "kept int, given double, size int").first()
    assert got["kept"] == 0 and got["given"] > 200


def test_gradients_by_distinct_ids_are_those_of_every_place():
    r, k = np.random.default_rng(6), attention_lm.CLASSES
    classes = r.integers(0, k, 49408).astype(np.int32)
    bigram = np.log(r.dirichlet(np.ones(k), k + 1)).astype(np.float32)
    vectors = r.standard_normal((49409, attention_lm.AXES + attention_lm.CODE)).astype(np.float32)
    docs, w = [np.append(r.integers(0, 50, n), 49407) for n in (3, 200, 64, 0)], attention_lm.Weights.fresh()
    inputs, targets, _, depth = attention_lm.blocks_of(docs, 49408)
    past, named, t = attention_lm.previous(inputs), np.append(classes, k), targets.reshape(-1)
    for own in (vectors, None):
        (got,) = attention_lm.gradients(w, bigram, docs, classes, own, r)
        at = None if own is None else own[np.concatenate([past, inputs], axis=1)]
        p, held = attention_lm.forward(w, bigram, named[inputs], named[past], depth, keep=True, vectors=at)
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(t)), named[np.maximum(t, 0)]] -= 1
        p[t < 0] = 0
        want = attention_lm.backward(w, named[inputs], held, p / np.float32((t >= 0).sum()))
        assert got.keys() == want.keys() == w.keys()
        assert all(np.allclose(got[n], want[n], rtol=1e-3, atol=1e-5 * np.abs(want[n]).max()) for n in want)


def test_attention_reads_ids_and_not_classes_alone():
    r, k = np.random.default_rng(8), attention_lm.CLASSES
    classes = np.full(49408, 3, np.int32)
    classes[:100] = np.arange(100)
    company, counts = r.integers(0, 9, (49408, 2 * attention_lm.COMPANY)), r.integers(1, 50, 49408)
    bigram, inside = np.full((k + 1, k), -math.log(k), np.float32), np.zeros((k + 1, 49408), np.float32)
    vectors = attention_lm.own_vectors(company, counts)
    model = attention_lm.Model(classes, inside, bigram, attention_lm.Weights.fresh(), 0, vectors)
    text = r.integers(0, 100, 60)
    for place in (20, 30):  # of the class of its neighbour 200; more than 16 ids before the last
        one, other = text.copy(), text.copy()
        one[place], other[place] = 200, 201
        assert classes[200] == classes[201] and abs(model.score([one])[0] - model.score([other])[0]) > 1e-6
    w, docs = attention_lm.Weights({n: x.astype(np.float64) for n, x in attention_lm.Weights.fresh().items()}), [text, text[:9]]
    inputs, targets, _, depth = attention_lm.blocks_of(docs, 49408)
    before, named = attention_lm.previous(inputs), np.append(classes, k)
    own, t = vectors[np.concatenate([before, inputs], axis=1)].astype(float), classes[np.maximum(targets.reshape(-1), 0)]
    run = lambda keep: attention_lm.forward(w, bigram, named[inputs], named[before], depth, keep=keep, vectors=own)
    logits, held = run(True)
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    seen = targets.reshape(-1) >= 0
    fast = np.log(p[seen, t[seen]]).sum() / math.log(10)
    assert model.score(docs).sum() == pytest.approx(fast, rel=1e-5)
    # The last id of a text sees the whole window, 32 ids before its block.
    far = text.copy()
    far[25] = 201
    moved = attention_lm.blocks_of([far], 49408)[0]
    late = lambda x: attention_lm.forward(w, bigram, named[x], named[attention_lm.previous(x)], depth[:8], vectors=vectors[np.concatenate([attention_lm.previous(x), x], axis=1)])[56:60]
    assert not np.allclose(late(inputs[:8]), late(moved), atol=1e-6)
    grad = p.copy()
    grad[np.arange(len(t)), t] -= 1
    grad[~seen] = 0
    g = attention_lm.backward(w, named[inputs], held, grad)
    for name in "ptqkv":
        at, eps, sums = tuple(r.integers(0, n) for n in w[name].shape), 1e-5, []
        for step in (eps, -2 * eps):
            w[name][at] += step
            y = run(False)
            sums.append((np.log(np.exp(y).sum(axis=1)) - y[np.arange(len(t)), t])[seen].sum())
        w[name][at] += eps
        assert g[name][at] == pytest.approx((sums[0] - sums[1]) / (2 * eps), rel=2e-2, abs=1e-4), name


def test_scores_are_those_of_the_forward_pass():
    r, k = np.random.default_rng(5), attention_lm.CLASSES
    bigram = np.log(r.dirichlet(np.ones(k), k + 1)).astype(np.float32)
    classes = r.integers(0, k, 49408).astype(np.int32)
    inside = -r.random((k + 1, 49408)).astype(np.float32)
    model = attention_lm.Model(classes, inside, bigram, attention_lm.Weights.fresh())
    texts = [r.integers(0, 5000, n).astype("<u2") for n in (1, 8, 9, 300)]
    for t, got in zip(texts, model.score(texts), strict=True):
        own = classes[t]
        inputs, targets, _, first = attention_lm.blocks_of([own])
        logits = attention_lm.forward(model.weights, bigram, inputs, attention_lm.previous(inputs), first)[: len(t)].astype(float)
        want = (logits[np.arange(len(t)), own] - np.log(np.exp(logits).sum(axis=1))).sum() + inside[np.concatenate([[k], own[:-1]]), t].sum()
        assert got == pytest.approx(want / np.log(10), rel=1e-5)


# 4


def test_language_id(spark):
    pools = {"en": "the quick brown fox jumps over lazy dogs while thinking".split(), "fr": "le renard brun très rapide saute par dessus chiens été".split(), "de": "der schnelle braune fuchs springt über faule hunde während".split()}
    r = random.Random(1)
    texts, langs = [], []
    for n in range(120):
        la = list(pools)[n % 3]
        texts.append(" ".join(r.choice(pools[la]) for _ in range(30)))
        langs.append(la if n % 7 else None)
    texts += [None, "", "123 !!", "x", LONG]
    langs += [None, "en", None, None, None]
    got = {x["doc_id"]: x for x in language_id.language_query(clashing(table(spark, texts, langs=langs))).collect()}
    assert all(got[n]["lang_pred"] == list(pools)[n % 3] for n in range(120))
    assert [got[n]["lang_pred"] for n in (120, 121, 122)] == ["und"] * 3 and got[123]["lang_pred"] in pools
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert language_id.language_query(table(spark, [])).count() == 0
    assert language_id.language_query(table(spark, ["a b"])).first()["lang_pred"] == "und"
    odd = language_id.language_query(table(spark, [*texts[:40], "²½ Ⅷ", texts[0], texts[0]], [*range(40), 900, None, None], [*langs[:40], None, None, None])).collect()
    assert [x["lang_pred"] for x in odd if x["doc_id"] == 900] == ["und"] and [(x["held_out"], x["lang_pred"]) for x in odd if x["doc_id"] is None] == [(True, "en")] * 2


def test_filter_holds_every_gram_and_its_corrected_counts_are_near_the_exact_ones(spark):
    small = 11  # slot bits, so few that false positives are many
    r = random.Random(5)
    languages = [f"l{n:02}" for n in range(70)]  # two planes
    own = {la: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)] for la in languages}
    train = [(la, " ".join(own[la][n % 40 :])) for la in languages for n in range(0, 40, 20)]
    counts = language_id.count_grams(spark.createDataFrame([(t, la) for la, t in train], "text string, lang string"), languages)
    exact = {la: collections.Counter() for la in languages}
    for la, t in train:
        exact[la].update(language_id.gram_names([t])[0].tolist())
    assert {(languages[x["language"]], x["name"]): x["n"] for x in counts.collect()} == {(la, g): n for la, c in exact.items() for g, n in c.items()}
    rate = {la: {g: n / sum(c.values()) for g, n in c.items()} for la, c in exact.items()}
    best = collections.defaultdict(float)
    for c in rate.values():
        for g, x in c.items():
            best[g] = max(best[g], x)
    members = {la: {g for g, x in c.items() if x >= language_id.SHARE * best[g]} for la, c in rate.items()}
    found = language_id.member_grams(counts)
    assert {(languages[x["language"]], x["name"]) for x in found.collect()} == {(la, g) for la, c in members.items() for g in c}
    planes = language_id.build_filter(language_id.filter_slots(found, small).toPandas(), 70, small)
    fill = language_id.filter_fill(planes, 70)
    for n, la in enumerate(languages):
        bits = [planes[n // 64][s] >> np.uint64(n % 64) & np.uint64(1) for s in language_id.slots_of(np.array(sorted(members[la])), small)]
        assert all(b.all() for b in bits)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(8000))  # mostly grams of no language
    grams, per = language_id.gram_names([text])
    scores = language_id.filter_scores(planes, fill, [text])[0]
    want = np.array([np.isin(grams, sorted(members[la])).sum() for la in languages])
    wrong = fill**language_id.PROBES
    raw = scores * (1 - wrong) + wrong * per[0]  # hits before the correction
    assert np.abs(raw - want).mean() > 0.02 * per[0] and np.abs(scores - want).mean() < 0.25 * np.abs(raw - want).mean()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {x["doc_id"]: x["lang"] for x in docs.select("doc_id", "lang").collect()}
    held = [x for x in language_id.language_query(docs).collect() if x["held_out"] and x["lang_pred"] != "und"]
    most = collections.Counter(truth.values()).most_common(1)[0][1] / len(truth)
    right = sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) / len(held)
    assert len(held) > 200 and right > max(most, 0.95)


# 5


@pytest.mark.parametrize("num,den,width,block,refine", [(4, 5, 5, 400, 2), (4, 5, 5, 100, 0), (85, 100, 4, 400, 2), (1, 1, 2, 400, 2), (1, 2, 3, 200, 1)])
def test_ngram_join_by_brute_force(spark, num, den, width, block, refine, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_join, "REFINE", refine)
    monkeypatch.setattr(ngram_join, "ASK_FIRST", 1)
    r = random.Random(num)
    common = words(12, 77, 50)
    texts = []
    for n in range(90):
        if n % 3 and texts:
            own = texts[r.randrange(len(texts))].split()
            for _ in range(r.randint(0, 2)):
                if own:
                    own[r.randrange(len(own))] = f"E{r.randrange(9)}"
        else:
            own = words(r.choice([1, 3, 6, 30, 120]), n, 3000) + common * (n % 2)
        texts.append(" ".join(own))
    texts += [None, "", " \n", "A b", "a B"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(clashing(table(spark, texts)), width, num, den).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.ngram_components(table(spark, [])).count() == 0
    got = [(x["doc_id"], x["component_id"]) for x in ngram_join.ngram_components(table(spark, ["a b c d e f"] * 4, [7, 7, None, 9])).collect()]
    assert sorted(got, key=str) == [(7, 7), (7, 7), (9, 7), (None, 7)]


def test_links_through_rows_without_ids(spark):
    base = words(60, 3, 5000)
    texts = [" ".join([*base[:55], *(f"x{n}" for n in range(5 * k))]) for k in range(3)]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.85
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    got = ngram_join.ngram_components(table(spark, [*texts, texts[1], "alone here now ok"], [5, None, 8, None, None]), 4, 85, 100).collect()
    assert sorted(((x["doc_id"], x["component_id"]) for x in got), key=str) == [(5, 5), (8, 5), (None, 5), (None, 5), (None, None)]


def test_representatives_are_rows_and_not_ids(spark):
    a, b, c = (" ".join(words(40, n, 5000)) for n in (1, 2, 3))
    near = a.rsplit(" ", 1)[0]
    rows = [(3, a), (3, b), (5, near), (3, a), (None, c), (None, c), (None, b), (7, ""), (7, None), (None, "")]
    docs = clashing(table(spark, [t for _, t in rows], [i for i, _ in rows]))
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    want = [(3, a), (3, b), (None, c), (7, ""), (7, None), (None, "")]
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted(want, key=str)
    assert ngram_join.keep_representatives(table(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(n, n + 1) for n in range(500, 560)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in up)


# 6


def test_line_dedup_by_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(words(r.randint(3, 60), n, 900)) for n in range(25)]
    texts = []
    for n in range(40):
        own = [r.choice(pool) if r.random() < 0.6 else " ".join(words(9, 500 + 31 * n + k)) for k in range(r.randint(1, 12))]
        if n % 4 == 3:
            own = texts[n - 2].split("\n") + own
        texts.append("\n".join(own + [""] * (n % 2)))
    texts += [None, "", texts[3], "\n".join([pool[0]] * 9)]
    seqs = [[(k, x.strip(), len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]
    first, gone = {}, collections.defaultdict(set)
    for i, s in enumerate(seqs):
        for a in range(len(s)):
            total = 0
            for b in range(a, len(s)):
                total += s[b][2]
                if total < 50:
                    continue
                key = tuple(x for _, x, _ in s[a : b + 1])
                at = first.setdefault(key, (i, a))
                if at != (i, a) and (at[0] != i or a >= at[1] + b + 1 - a):
                    gone[i].update(k for k, _, _ in s[a : b + 1])
                if total >= 400:
                    break
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(clashing(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        have = {k for x in got[i]["removed"] for k in range(x["first"], x["end"])}
        assert have == gone[i], i
        assert got[i]["text"] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in have) if t else "")
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# 7


def test_toxicity_learns_words_and_keeps_odd_rows(spark):
    r = random.Random(6)
    texts = [" ".join(words(40, n) + ["scum"] * (n % 4 == 0)) for n in range(400)] + [None, "", "scum", LONG]
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(400)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity_query(clashing(table(spark, texts)), labels).collect()}
    assert all(got[n]["predicted"] == (n % 4 == 0) for n in range(400)) and got[402]["predicted"] == 1
    assert got[400]["predicted"] == got[401]["predicted"] == got[403]["predicted"] == 0
    assert toxicity.toxicity_query(table(spark, []), labels).count() == 0
    assert toxicity.toxicity_query(table(spark, ["a"]), labels.limit(0)).first()["predicted"] == 0


def test_toxicity_finds_copies_without_telling_words(spark):
    texts = [" ".join(words(40, n) + ["scum"] * (n % 4 == 0)) for n in range(200)] + ["fifty odd zebras", "fifty odd zebras ran", "unheard"]
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(201)], "doc_id long, toxic int")
    docs = table(spark, texts)
    model = toxicity.fit_model(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[n]["neighbours"][0] == n and got[n]["cosines"][0] == pytest.approx(1) for n in range(201))
    assert got[201]["neighbours"][0] == 200 and 0.7 < got[201]["cosines"][0] < 0.9 and got[202]["neighbours"] == []
    made = [model.vectors(t) for t in texts]
    unit = np.zeros((len(made), len(model.vectors)))
    for n, (which, weight) in enumerate(made):
        unit[n, which] = weight
    for n in range(0, 202, 7):
        cosine = unit[:201] @ unit[n]
        best = np.sort(cosine[cosine > 0])[::-1][:15]
        assert np.allclose(got[n]["cosines"], best)


def test_equal_toxicity_examples_are_one(spark):
    texts = [" ".join(words(20, n)) for n in range(30)] + ["the very same words"] * 40
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(70)], "doc_id long, toxic int")
    model = toxicity.fit_model(table(spark, texts), labels)
    assert sorted(model.ids.tolist()) == list(range(31)) and model.toxic[model.ids.tolist().index(30)] == pytest.approx(0.25)


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    dense = r.random((500, 30)) * (r.random((500, 30)) < 0.15)
    dense[100:140] = dense[7]
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    vectors = [(np.flatnonzero(x), x[x > 0]) for x in unit]
    index = toxicity.BlockMaxIndex(vectors, 30)
    for n in range(0, 500, 9):
        cosine = unit @ unit[n]
        cosine[n] = 0
        order = np.lexsort((np.arange(500), -np.round(cosine, 12)))[:15]
        found, got = index.nearest(vectors[n], 15, n)
        want = [m for m in order if cosine[m] > 0]
        assert found.tolist() == want and np.allclose(got, cosine[want])


# 8


def test_pii_base_and_added_spans(spark):
    r = random.Random(5)

    def number():
        d = [r.randrange(10) for _ in range(15)]
        s = sum(v if n % 2 else (v * 2 - 9 * (v > 4)) for n, v in enumerate(d))
        return "".join(map(str, d)) + str(-s % 10)

    texts = []
    for n in range(200):
        kind = n % 5
        thing = [f"u{n}@m{n}.example.com", f"{n}.20.3.{n % 250}", number(), f"+{n % 9 + 1} (555) 010-{1000 + n}", f"{n} items"][kind]
        texts.append(" ".join(words(8, n)) + f" {thing} " + " ".join(words(5, n + 7)))
    texts += [None, "", "a@b", "@@ a@b.c@d.e 1.2.3.999 9", LONG, "call +1 (555) 010-2000 and x@y.zz, 1.2.3.4.5.6.7.8"]
    got = {x["doc_id"]: x for x in pii.pii_query(clashing(table(spark, texts))).collect()}
    import re

    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for n, t in enumerate(texts):
        want = []
        for kind, rule in rules.items():
            for m in re.finditer(rule, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                    want.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[n]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[n]["spans"].split(",")))
    assert sum(x["n_added"] for i, x in got.items() if i % 5 == 4 and i < 200) == 0
    assert pii.pii_query(table(spark, [])).count() == 0


def test_long_runs_of_address_signs_take_linear_time():
    import re
    import time

    rule = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(6)
    for n in range(3000):
        t = "".join(r.choice("ab.@-_ ") for _ in range(r.randrange(30)))
        assert list(pii._emails(t)) == [m.span() for m in rule.finditer(t)], t
    began = time.process_time()
    assert list(pii._emails("a" * 300_000 + "@ " + "b@" * 100_000 + "a@b.c")) and time.process_time() - began < 5


def test_semi_markov_sums_match_enumeration():
    z = pii.Zone("a 12-34567 b", 0, 12)
    scores = np.random.default_rng(1).standard_normal((len(z.segments), len(pii.KINDS)))
    total, marginal = 0.0, np.zeros_like(scores)

    def walk(at, weight, used):
        nonlocal total
        if at == z.n:
            total += math.exp(weight)
            for k, t in used:
                marginal[k, t] += math.exp(weight)
            return
        walk(at + 1, weight, used)
        for k, (i, j) in enumerate(z.segments):
            if i == at:
                for t in range(len(pii.KINDS)):
                    walk(j, weight + scores[k, t], [*used, (k, t)])

    walk(0, 0.0, [])
    got, log_total = z.posteriors(scores)
    assert log_total == pytest.approx(math.log(total)) and np.allclose(got, marginal / total)


# 9, 10


def ids_of(kind, path, text):
    return np.array(encoder(kind, path).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_packing(spark):
    texts = [*ODD, *(" ".join(words(n * 7 % 900, n)) for n in range(80))]
    got = packing.best_fit_pack(clashing(table(spark, texts)), BYTE, 256, 0, with_ids=True).collect()
    per, rows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        per[r["doc_id"]].append(r)
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for n, t in enumerate(texts):
        want = np.append(ids_of("byte", BYTE, t), 0).astype("<u4")
        own = sorted(per[n], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == want.tobytes()
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in own)
        assert len(own) == -(-len(want) // 256)
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(rows) <= 1.03 * -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.best_fit_pack(table(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("n,want", [(904, [904]), (2048, [2048]), (4096, [2048, 2048]), (5000, [904, 2048, 2048])])
def test_only_the_first_piece_is_shorter(spark, n, want):
    text = " a" * (n - 1)
    ids = np.append(ids_of("byte", BYTE, text), 0).astype("<u4")
    own = sorted(packing.best_fit_pack(table(spark, [text]), BYTE, 2048, 0).collect(), key=lambda r: r["piece"])
    assert len(ids) == n and [r["length"] for r in own] == want
    assert [r["start"] for r in own] == np.cumsum([0, *want[:-1]]).tolist()
    assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 4000)
    texts = [*ODD, *(" ".join(words(n * 11 % 700, n % 5)) for n in range(60)), "# ## #"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    files = token_files.write_token_files(clashing(table(spark, texts, ids)), WORD, 2)
    got = {r["doc_id"]: r for r in token_files.read_token_files(files.read(), with_ids=True).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = np.append(ids_of("word", WORD, t), 2).astype("<u4")
        assert bytes(got[i]["ids"]) == want.tobytes() and got[i]["start"] == start and got[i]["ids_crc32"] == zlib.crc32(want.tobytes())
        start += len(want)
    empty = token_files.write_token_files(table(spark, []), WORD, 2)
    assert token_files.read_token_files(empty.read()).count() == 0


def test_pairs_are_replaced_until_none_is_frequent():
    r = np.random.default_rng(4)
    passage = r.integers(10, 9000, 700)
    docs = [np.full(5000, 7), np.full(333, 7), *[np.concatenate([passage, r.integers(10, 9000, 3)]) for _ in range(40)], np.tile([11, 11, 12], 90), np.array([], int)]
    docs = [np.append(d, 2).astype("<u4") for d in docs]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    data = token_files.write_file(list(range(len(docs))), ends, ids, 0, 2)
    f = token_files.TokenFile(data)
    assert all(np.array_equal(f.decode(n), d) for n, d in enumerate(docs))
    symbols = f.symbols.tolist()
    end = f.letters.tolist().index(2)
    left = collections.Counter(p for p in zip(symbols, symbols[1:]) if end not in p)
    assert max(left.values()) < token_files.MIN_PAIR and f.length.max() > 500
    assert len(symbols) < len(ids) // 50 and len(symbols[: f.symbol_ends[0]]) < 100


def test_vocabularies_of_any_size(monkeypatch):
    ids = np.concatenate([np.array([70000, 5, 2, 9, 2]), np.tile([90001, 5, 3_000_000, 8], 50), [2]]).astype("<u4")
    ends = np.array([3, 5, len(ids)])
    for wide in (False, True):
        if wide:
            monkeypatch.setattr(token_files, "_MOST_LETTERS", 3)
        f = token_files.TokenFile(token_files.write_file([1, None, 4], ends, ids, 7, 2))
        assert f.wide == wide and f.doc_ids == [1, None, 4] and f.decode(0).tolist() == [70000, 5, 2] and f.decode(1).tolist() == [9, 2]
        assert f.decode(2).tolist() == ids[5:].tolist() and wide == (len(f.symbols) > 60)


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORD)])
def test_cached_ids_are_the_tokenizers_own(kind, path):
    enc = encoder(kind, path)
    for t in [*filter(None, ODD[:5] + ODD[7:]), "  a\n\n b  ", "\x1c x\x85", "It's we'll 'S x's", "<|startoftext|>.a", "Aİ ﬁ Ⅷ", "a.b,c d.,. .e"]:
        assert enc.ids(t) == enc.whole(t), t


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORD)])
def test_ids_of_a_whole_table_are_the_tokenizers_own(kind, path, monkeypatch):
    from lattica.llm import tokens

    import pyarrow.parquet as pq

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3000)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    enc = tokens.ByteBpe(path) if kind == "byte" else tokens.WordBpe(path)
    marks = [t.replace(" ", "  ", 3).replace(". ", ".\n ", 2) + " \n" * (n % 3) for n, t in enumerate(texts[:300])]
    every = [*texts, *marks, *(" " + t[:200] + "\n" for t in texts[:300]), *(t + " <|endoftext|>x\xa0y" for t in texts[:20])]
    for t, ids in zip(every, enc.ids_of_each(every), strict=True):
        assert ids.tobytes() == enc.whole(t), t
    assert list(enc.ids_of_each([])) == [] and [len(x) for x in enc.ids_of_each(["", "", "a"])] == [0, 0, 1]


def test_hashes_name_words_and_tables_number_them(monkeypatch):
    from lattica.llm import hashing

    monkeypatch.setattr(hashing, "BLOCK", 64)
    hashing._powers.cache_clear()
    r = random.Random(1)
    texts = ["".join(r.choice("aAb \t\né\x1c") for _ in range(n)) for n in [0, 1, 5, 300, 40, 0, 3]] + ["x" * 1500 + " " + "x" * 1501, "y" * 999 + " z"]
    w = hashing.Words(texts, hashing.values(lower=True))
    hashing._powers.cache_clear()
    known = {}
    for n, t in enumerate(texts):
        own, got = t.encode().lower().split(), w.hash[w.first[n] : w.first[n + 1]].tolist()
        assert len(own) == len(got) and all(known.setdefault(h, x) == x for h, x in zip(got, own, strict=True))
    assert len(set(known.values())) == len(known) and 0 not in known
    hashes, table = np.array(list(known), np.uint64), hashing.Table(len(known) // 2)
    told = []
    for part in (hashes[:5], hashes, hashes[:7], np.repeat(hashes[:3], 4)):
        numbers = table.numbered(part, lambda first, new, at, part=part: told.append((first, new.tolist(), part[at].tolist())))
        assert len(set(numbers.tolist())) == len(set(part.tolist())) and (table.find(part) == numbers).all() and numbers.min() >= 0
    assert [t[0] for t in told] == [0, 0] and all(a == b for _, a, b in told)


def test_shingle_sets_by_brute_force():
    from lattica.llm.words import shingle_sets

    r = random.Random(3)
    texts = [" ".join(r.choice("aAbc") for _ in range(n)) for n in (0, 1, 2, 3, 9, 50)] * 2
    for width in (1, 3):
        names = {}
        for t, s in zip(texts, shingle_sets(iter(texts), width), strict=True):
            own = t.lower().split()
            want = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if len(own) >= width else {tuple(own)} - {()}
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all() and names.setdefault(frozenset(want), s.tobytes()) == s.tobytes()
