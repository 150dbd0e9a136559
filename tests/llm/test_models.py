"""Toxicity, quality and language model: held-out accuracy, exact statistics, defined cases."""

import math
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from askloom.llm import maxent_lm, ordinal_quality, queries, toxicity, words

BLANKS = "[\x20\x09-\x0d]+"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    label, score = np.array([r["toxic"] for r in held]), np.array([r["score"] for r in held])
    assert auc(label, score) > 0.95
    assert (label == (score >= 0.5)).mean() > 0.96


def test_toxicity_features():
    texts = ["You IDIOT, you moron!!", "you 1d10t and m*o*r*o*n", "a calm text", "", None]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    none = np.zeros(0, np.uint64), np.zeros(0)
    rows = dict(zip(toxicity.FEATURES, toxicity.features_of(batch, "text", *none).T, strict=True))
    assert rows["hits"].tolist() == [2, 2, 0, 0, 0]
    assert rows["disguised_rate"][0] == 0 < rows["disguised_rate"][1]
    assert rows["near_person"].tolist() == [2, 0, 0, 0, 0]
    assert rows["capital_hits"].tolist() == [1, 0, 0, 0, 0]
    assert rows["exclamations"][0] > 0 == rows["exclamations"][2]


def test_toxicity_features_take_little_memory():
    texts = ["You are an idiot! calm words, 1d10t " * 60] * 4000
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = []

    class Docs:
        schema = toxicity.StructType()

        def mapInArrow(self, run, _):
            made.extend(b.num_rows for b in run(iter([batch])))

    tracemalloc.start()
    try:
        toxicity.featurize(Docs(), "text", "features", (np.zeros(0, np.uint64), np.zeros(0)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(made) == len(texts)
    assert batch.nbytes > 8 << 20 and peak < 100 << 20, peak


def test_toxicity_tasks_load_no_spark_ml():
    code = "import sys, askloom.llm.toxicity; print([m for m in sys.modules if m.startswith('pyspark.ml')])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=toxicity.__file__.split("/askloom/")[0]).stdout.strip() == "[]"


def test_toxicity_nasty(spark, nasty, no_docs, some_labels):
    rows = toxicity.score(nasty, some_labels).collect()
    assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert toxicity.score(no_docs, some_labels).collect() == []
    no_labels = some_labels.where("false")
    assert {r["score"] for r in toxicity.score(nasty, no_labels).collect()} == {0.5}
    assert toxicity.accepted(nasty, no_labels, threshold=0.6).columns == nasty.columns
    assert toxicity.accepted(nasty, no_labels, threshold=0.6).count() == nasty.count()


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op3_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in rows)
    assert (np.array([r["quality"] for r in held]) == np.array([r["keep"] for r in held])).mean() > 0.97


def test_quality_gradient_is_the_likelihood_s():
    rng = np.random.default_rng(3)
    score, grade, t = rng.normal(size=40), rng.integers(0, 3, 40), np.array([-0.4, 0.9])
    by_score, by_threshold, value = ordinal_quality.gradient(score, grade, t)
    e = 1e-6
    for i in range(5):
        moved = score.copy()
        moved[i] += e
        assert abs((ordinal_quality.gradient(moved, grade, t)[2] - value) / e - by_score[i]) < 1e-4
    for k in range(2):
        moved = t.copy()
        moved[k] += e
        assert abs((ordinal_quality.gradient(score, grade, moved)[2] - value) / e - by_threshold[k]) < 1e-4


def test_quality_nasty(nasty, no_docs, some_labels):
    ratings = ordinal_quality.graded(some_labels)
    rows = ordinal_quality.score(nasty, ratings).collect()
    assert len(rows) == nasty.count() and all(0 <= r["tail_probability"] <= 1 for r in rows)
    assert ordinal_quality.score(no_docs, ratings).collect() == []
    assert len(ordinal_quality.score(nasty, ratings.where("false")).collect()) == nasty.count()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(BLANKS, low) if w] + [None]


def test_language_model_statistics(spark, sf_dir, documents):
    texts = {r["doc_id"]: tokens(r["text"]) for r in documents.collect()}
    counts = Counter(t for k, ts in texts.items() if fold(k, 7) != 2 for t in ts)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op10_lm_scores(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ts = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(t in counts for t in ts), n, fold(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    # Far better than the base: n-grams of the learning texts decide, not only classes.
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


VOCABULARY = [f"w{k}{c}" for k in range(8) for c in "abcde"]


def small_model(spark, extra=()):
    """A model of 150 random texts (learned), and the blocks of these and of ``extra`` texts (held out)."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, len(VOCABULARY) + 1)
    texts = [" ".join(rng.choice(VOCABULARY, rng.integers(0, 12), p=share / share.sum())) for _ in range(150)]
    rows = [(k, t, False) for k, t in enumerate(texts)] + [(1000 + k, t, True) for k, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "id long, text string, held boolean").repartition(3, "id")
    table, tables = maxent_lm.counted(maxent_lm.staged(maxent_lm.blocks(docs, size=800), "t-blocks"))
    assert table.count() > 3
    model = maxent_lm.fit(table, tables)
    return texts, model, table.toArrow().combine_chunks().to_batches()


def probabilities(b, model):
    """P(token | history) of every token, by text, with the gate's softmax written out."""
    out, at = {}, 0
    for doc, n in zip(b.ids, b.n, strict=True):
        out[doc] = []
        for k in range(at, at + n):
            weight = [math.exp(sum(model.gate[r, x] for r in b.e.rows[:, k])) * bool(b.e.there[k, x]) for x in range(maxent_lm.EXPERTS)]
            out[doc].append(sum(w * s for w, s in zip(weight, b.e.shares[k], strict=True)) / sum(weight))
        at += n
    return out


def test_language_model_probabilities_sum_to_one(spark):
    unseen, k = {}, 0
    while len(unseen) < maxent_lm.TAILS:
        data = np.frombuffer(f"u{k}".encode(), np.uint8)
        unseen.setdefault(int(maxent_lm.tail_class(data, np.array([0]), np.array([len(data)]))[0]), f"u{k}")
        k += 1
    words_after = [*VOCABULARY, *unseen.values()]
    a, b = VOCABULARY[0], VOCABULARY[1]
    histories = [f"{a} {b}", f"{VOCABULARY[-1]} {a}", f"{a} nowhere", ""]
    extra = [f"{h} {t}".strip() for h in histories for t in ["", *words_after]]
    texts, model, batches = small_model(spark, extra)
    assert {w for t in texts for w in t.split()} == set(VOCABULARY)
    p = {}
    for block in maxent_lm.counted_blocks(iter(batches), model):
        p |= probabilities(block, model)
    each = 1 + len(words_after)
    for k, h in enumerate(histories):
        at = len(h.split())
        total = sum(p[1000 + k * each + j][at] for j in range(each))
        assert math.isclose(total, 1.0, rel_tol=1e-4), (h, total)


def test_language_model_evidence_by_brute_force(spark):
    extra = [f"{VOCABULARY[0]} {VOCABULARY[1]} {VOCABULARY[2]}", "all of it new", VOCABULARY[3], ""]
    texts, model, batches = small_model(spark, extra)
    seen, hits = Counter(), Counter()
    kinds = (lambda one, two: one, lambda one, two: (two, one), lambda one, two: two)

    def places(text):
        """Each token with its three histories (None where there is none to ask)."""
        padded = ["<", "<", *text.split(), "."]
        for two, one, t in zip(padded, padded[1:], padded[2:]):
            known = (True, one != "<", two != "<")
            yield t, [(k, of(one, two)) if known[k] else None for k, of in enumerate(kinds)]

    for t, hs in (x for text in texts for x in places(text)):
        for h in filter(None, hs):
            seen[h] += 1
            hits[h, t] += 1
    all_texts = dict(enumerate(texts)) | {1000 + k: t for k, t in enumerate(extra)}
    for own in (0, 1):
        for b in maxent_lm.counted_blocks(iter(batches), model, own):
            at, p, got = 0, probabilities(b, model), maxent_lm.score_block(b, model)[2]
            for k, (doc, n) in enumerate(zip(b.ids, b.n, strict=True)):
                for i, (t, hs) in enumerate(places(all_texts[doc])):
                    for x, h in enumerate(hs):
                        left = max(seen[h] - own, 0) if h else 0
                        assert b.e.there[at + i, x + 1] == (left > 0)
                        assert math.isclose(b.e.shares[at + i, x + 1], max(hits[h, t] - own, 0) / left if left else 0.0, abs_tol=1e-12)
                at += n
                assert math.isclose(got[k], sum(math.log10(x) for x in p[doc]), rel_tol=1e-6)


def test_language_model_gate_gradient_is_the_likelihood_s(spark):
    _, model, batches = small_model(spark)
    b = next(maxent_lm.counted_blocks(iter(batches), model, own=1))
    some, e = np.arange(20), 1e-6
    error, value = maxent_lm.gate_gradient(model.gate, b.e, some)
    for k in range(maxent_lm.EXPERTS):
        row = b.e.rows[0, 3]
        moved = model.gate.copy()
        moved[row, k] += e
        expected = error[b.e.rows[0, some] == row, k].sum()
        assert abs((maxent_lm.gate_gradient(moved, b.e, some)[1] - value) / e - expected) < 1e-4


def test_language_model_scores_do_not_depend_on_tasks(spark, documents):
    docs = documents.limit(400).select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 5 == 0).alias("held"))
    table, tables = maxent_lm.counted(maxent_lm.staged(maxent_lm.blocks(docs, size=1 << 15), "t-blocks"))
    one, many = maxent_lm.fit(table.coalesce(1), tables), maxent_lm.fit(table.repartition(7), tables)
    assert np.allclose(one.weights, many.weights, atol=1e-4) and np.allclose(one.gate, many.gate, atol=1e-4)


def test_language_model_scores_sort_no_tokens(spark, monkeypatch):
    _, model, batches = small_model(spark)
    sorted_ = []
    for name in ("argsort", "sort", "unique"):
        monkeypatch.setattr(np, name, lambda a, *x, _plain=getattr(np, name), **k: (sorted_.append(len(a)), _plain(a, *x, **k))[1])
    for own in (0, 1):
        for b in maxent_lm.counted_blocks(iter(batches), model, own):
            maxent_lm.score_block(b, model)
    assert sorted_ == []


def test_language_model_nasty(nasty, no_docs):
    rows = maxent_lm.score(nasty).collect()
    assert len(rows) == nasty.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 1
    assert by_id[None]["held_out"] is False
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert maxent_lm.score(no_docs).collect() == []


def test_long_texts_are_cut_into_steps_without_change(monkeypatch):
    text = "word " * 50 + "x" * 3000 + " " * 100 + "last"
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = words.words_of(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(words, "STEP", 64)
    cut = words.words_of(raw, np.array([0, len(raw)]))
    assert (whole.hashes == cut.hashes).all() and (whole.starts == cut.starts).all() and (whole.ends == cut.ends).all()
