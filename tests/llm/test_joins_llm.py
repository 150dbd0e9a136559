"""Line windows, n-gram join, decontamination, top-k and chat rotation: brute force, SQL and defined cases."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from askloom import session
from askloom.llm import chat_rotation, components, decontamination, line_dedup, ngram_join, queries, topk, words
from tools.check import rows

BLANKS = "[\x20\x09-\x0d]+"


def word_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(BLANKS, low) if w]


def shingle_set(text, size):
    w = word_list(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(docs, size, num, den):
    """{id: (set size, least reachable id)} by comparing all pairs."""
    sets = [(k, shingle_set(t, size)) for k, t in docs if k is not None]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k, _ in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, rel.fetchall())


def test_line_windows(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\n a \nb\r\nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, "\n\n\n\n"), (5, "a\nb"), (6, "b\nc\nd"), (7, "a\nb\nc\nd")]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in out}
    # Later windows cover their lines: all of those of 2 that repeat 1, all of 6 and 7; in 3 the second and third window cover lines 2 to 5.
    assert got == {1: (docs[0][1], 0), 2: ("x\ny", 4), 3: ("q", 4), 4: (docs[3][1], 0), 5: ("a\nb", 0), 6: ("", 3), 7: ("", 4)}


def test_line_windows_nasty(nasty, no_docs):
    out = line_dedup.dedup_lines(nasty)
    assert out.columns == [*nasty.columns, "_n_lines_", "_n_removed_"]
    got = out.collect()
    assert len(got) == nasty.count()
    assert {(r["doc_id"], r["_n_removed_"]) for r in got if r["_n_removed_"]} == {(5, 4)}
    assert [r["text"] for r in got if r["doc_id"] == 1] == [None] and all(r["row"] == "keep row" for r in got)
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (None, 5), (200, 199), (199, 200)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 103: 100, 199: 199, 200: 199}


def near_copies(seed=1):
    """Groups of copies with a few words changed, a common passage, short texts, exact copies, and chains that link at their ends only."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choice(vocabulary, 40))
    docs, number = [], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(20, 150))))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            docs.append((number, " ".join(copy) + (" " + common if rng.random() < 0.4 else "")))
            number += 1
        chain = list(base)
        for _ in range(5):
            chain = chain[2:] + list(rng.choice(vocabulary, 2))
            docs.append((number, " ".join(chain)))
            number += 1
    docs += [(number + k, t) for k, t in enumerate(["one two", "One  TWO", "one", common, common + " end", "", " ", None])]
    return docs


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 8, 10), (2, 6, 10)])
def test_join_is_exact(spark, size, num, den):
    docs = near_copies(size)
    out = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), size, num, den).collect()
    want = brute_components(docs, size, num, den)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {k: len(shingle_set(t, size)) for k, t in docs}


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    docs = near_copies(9)
    out = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(docs, 4, 85, 100)


def test_join_nasty(nasty, no_docs):
    got = ngram_join.join(nasty).collect()
    assert len(got) == nasty.count()
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[None] is None and by_id[5] == 4 and all(by_id[k] == k for k in (1, 2, 3, 4, 6, 7, 8, 9))
    kept = ngram_join.one_per_group(nasty)
    assert kept.columns == nasty.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8", "9", "None"]
    assert ngram_join.join(no_docs).collect() == [] == ngram_join.one_per_group(no_docs).collect()


def test_shingles_of_rows_that_share_an_id_link_its_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(3, a), (3, b), (1, a), (2, b), (9, "c " * 9)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}


def test_rows_that_share_an_id_link_all_of_its_texts(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    docs = spark.createDataFrame([(9, a), (9, b), (9, c), (9, d), (1, a), (2, b), (3, c), (4, d), (7, "c " * 9)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.join(docs).collect()} == {(k, 1) for k in (1, 2, 3, 4, 9)} | {(7, 7)}
    assert sorted(r["doc_id"] for r in ngram_join.one_per_group(docs).collect()) == [1, 7]


def brute_matches(docs, items):
    """{(doc, item): similarity} over every window of every text."""
    ids, texts = zip(*[(k, t) for k, t in items if t], strict=True)
    w = decontamination.bare(pa.record_batch([pa.array(texts)], ["text"]))
    index = decontamination.Index(list(ids), [w.hashes[w.at[i] : w.at[i + 1]] for i in range(len(ids))])
    out = {}
    for doc, text in docs:
        h = decontamination.bare(pa.record_batch([pa.array([text], pa.string())], ["text"])).hashes
        own = set(decontamination.shingle_hashes(h).tolist())
        for k, item in zip(ids, index.items, strict=True):
            m, sh = len(item), decontamination.shingle_hashes(item)
            if m < decontamination.LEAST_WORDS or not own & set(sh.tolist()):
                continue
            best = max(decontamination.weighted_jaccard(decontamination.shingle_hashes(h[a : a + m]), sh, index.weight) for a in range(max(1, len(h) - m + 1)))
            if best >= decontamination.THRESHOLD:
                out[doc, k] = round(best, 9)
    return out


def test_decontamination_is_brute_force_s(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    want = brute_matches([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got == want and got


def test_multi_index_blocks_find_all_within_radius():
    rng = np.random.default_rng(2)
    known = rng.integers(0, 2**63, 300, dtype=np.uint64)
    asked = known[rng.integers(0, 300, 500)]
    for _ in range(4):
        asked = asked ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) * rng.integers(0, 2, 500).astype(np.uint64)
    tables = []
    for shift, width in decontamination.bit_blocks():
        key = (known >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        held = np.zeros(1 << width, bool)
        held[key.astype(np.int64)] = True
        order = np.argsort(key, kind="stable")
        tables.append((key[order], order, held))
    left, right = decontamination.near_pairs(asked, (known, None, None, None, tables))
    near = np.bitwise_count(asked[:, None] ^ known[None, :]) <= decontamination.RADIUS
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == set(map(tuple, np.argwhere(near).tolist()))


def test_simhash_is_the_majority_of_bits():
    hashes = words.mix(np.arange(40, dtype=np.uint64))
    for size in decontamination.WINDOWS[:4]:
        (got,) = decontamination.simhash(hashes, [(np.arange(40 - size + 1), size)])
        for s in range(40 - size + 1):
            want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[s : s + size]) > size)
            assert int(got[s]) == want


def test_decontamination_finds_changed_and_placed_passages(spark):
    item = " ".join(f"word{k}" for k in range(60))
    filler = " ".join(f"other{k}" for k in range(500))
    edited = item.replace("word30 ", "changed ")
    docs = [(1, item), (2, f"{filler} {item.upper().replace(' ', '!! ')}"), (3, f"{filler}, {edited} {filler}"), (4, filler), (5, item[: len(item) // 2]), (6, None)]
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, item)], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 3) for i in (7, 10)}
    assert got[1, 7]["similarity"] == 1.0 and got[2, 7]["first_word"] == 500 and 0.8 <= got[3, 7]["similarity"] < 1
    assert got[1, 7]["passage"] == item and got[1, 7]["n_words"] == 60
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(docs, items).collect()) == [4, 5, 6]


def matched(texts, items):
    w = decontamination.bare(pa.record_batch([pa.array(items)], ["text"]))
    index = decontamination.Index(list(range(len(items))), [w.hashes[w.at[i] : w.at[i + 1]] for i in range(len(items))])
    rows = decontamination.match_texts(decontamination.bare(pa.record_batch([pa.array(texts)], ["text"])), index)
    return {(t, k): round(s, 9) for t, k, s, _, _ in rows}


def test_decontamination_misses_no_edited_passage():
    rng = np.random.default_rng(5)
    items = [" ".join(f"i{m}w{k}" for k in range(m)) for m in (12, 63, 66, 70, 120, 127, 255)]
    items += [" ".join(f"r{k}" for k in rng.integers(0, 3, 40)), items[1] + " " + items[0]]
    texts = []
    for item in items:
        for edits in (1, 2, 4):
            for kind in range(3):
                said = item.split()
                # Edits in the middle, evenly spread, or anywhere.
                spots = [[len(said) // 2 + k for k in range(edits)], [(k + 1) * len(said) // (edits + 1) for k in range(edits)], rng.choice(len(said), edits, replace=False).tolist()][kind]
                for k in sorted(spots, reverse=True):
                    said[k : k + 1] = [[f"new{k}"], [], [said[k], "more"]][rng.integers(3)]
                texts.append(" ".join([f"f{k}" for k in range(rng.integers(0, 90))] + said + [f"g{k}" for k in range(rng.integers(0, 90))]))
    got = matched(texts, items)
    assert got == brute_matches(list(enumerate(texts)), list(enumerate(items))) and len(got) > 40


def test_decontamination_weights_are_over_the_whole_benchmark(spark, monkeypatch):
    rng = np.random.default_rng(9)
    common = " ".join(f"common{k}" for k in range(12))
    items = [(k, common + " " + " ".join(f"own{k}w{j}" for j in range(20))) for k in range(23)]
    docs = []
    for k, text in items:
        said = text.split()
        for spot in rng.choice(len(said), 2, replace=False):
            docs.append((100 * k + int(spot), "before " * 9 + " ".join([*said[:spot], "edited", *said[spot + 1 :]])))
    want = brute_matches(docs, items)
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([*docs, (-1, None), (-2, "clean")], "doc_id long, text string")
    for size in (5_000, 7):
        monkeypatch.setattr(decontamination, "INDEX_ITEMS", size)
        assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.matches(docs, items).collect()} == want
        kept = decontamination.clean_documents(docs, items)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["doc_id"] for r in docs.collect()} - {d for d, _ in want})
    assert want


def test_decontamination_finds_short_items_and_items_without_id(spark):
    items = [(1, "what is the largest planet"), (2, "What is the largest planet of all?"), (3, "x y x y x y"), (None, "an item without any id of its own here"), (5, "prime numbers"), (6, "")]
    docs = [(1, "q: what is the LARGEST planet? jupiter"), (2, "what is the largest planet of all"), (3, "what is the largest"), (4, "planet so y x y x y x"), (5, "an item without any id of its own here"), (6, "prime"), (7, "numbers"), (8, "odd prime numbers, prime numbers"), (9, "x y"), (10, None)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["passage"]) for r in decontamination.matches(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (4, 3), (5, None), (8, 5)}
    assert got[1, 1] == (1.0, 1, "what is the LARGEST planet") and got[8, 5] == (1.0, 1, "prime numbers") and {s for s, _, _ in got.values()} == {1.0}
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(docs, items).collect()) == [3, 6, 7, 9, 10]


def test_decontamination_nasty(spark, nasty, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve second line"), (2, ""), (3, "another item of nine words which nobody ever holds")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(nasty, items).collect()} == {(4, 1), (5, 1)}
    kept = decontamination.clean_documents(nasty, items)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 2
    assert decontamination.matches(no_docs, items).collect() == []
    assert decontamination.clean_documents(nasty, items.where("false")).count() == nasty.count()
    assert decontamination.matches(nasty, items.where("false")).collect() == []
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 1)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(nasty, items).collect()} == {(4, 1), (5, 1)}


def test_top_k_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(8)
    vectors = [(k, rng.normal(size=6).round(2).tolist()) for k in range(120)] + [(200 + k, [0.5] * 6) for k in range(30)]
    vectors += [(None, [1.0] * 6), (301, None), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] + [0.0] * 5), (304, [float("inf")] + [0.0] * 5), (305, [1.0]), (306, [])]
    vectors += [(250, [0.5] * 6), (250, [0.25] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("extra")).withColumn("id", F.lit("extra"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()]
    usable = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in vectors if k is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for k, v in usable:
        if k % 50 == 0:
            asked[k] = min(asked.get(k, tuple(v)), tuple(v))
    want = []
    for q, v in asked.items():
        scores = sorted((-int(np.dot(v, x)), k) for k, x in usable if k != q)
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert topk.top_k(df.where("vec_id IN (0, 1)"), F.col("vec_id") % 50 == 0, 5).count() == 1


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (20, 8))
    held = (centres[np.arange(4000) % 20] + rng.integers(-20, 20, (4000, 8))).astype(np.int64)
    pivots = centres.astype(float)

    def block(ids):
        table = np.sqrt(((held[ids][:, None, :] - pivots[None]) ** 2).sum(2)).T
        return np.array(ids), held[ids], np.ascontiguousarray(table)

    q, c, s, evaluated = topk.search_block(block(list(range(10))), block(list(range(4000))), 5)
    assert evaluated < 0.5 * 10 * 4000
    for k in range(10):
        exact = sorted((-int(held[k] @ held[j]), j) for j in range(4000) if j != k)[:5]
        assert [(-x, y) for x, y in zip(s[q == k].tolist(), c[q == k].tolist(), strict=True)] == exact


def test_chat_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(chat_rotation, "BLOCK", 2)
    turns = [
        (1, 0, "system", "rules"), (1, 1, "Ann|>\n", "hi"), (1, 2, "Bob", None), (1, 2, "Bob", None), (1, 3, None, "who"), (1, None, "Ann|>\n", "before"), (2, 0, "system", "alone"), (None, 5, "x", "y"), (3, 7, "", "z"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("extra")).withColumn("mask", F.lit("extra"))
    out = chat_rotation.segments(df)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    texts = {(r["conv_id"], r["perspective"]): (r["text"], [(s["start"], s["end"]) for s in r["spans"]]) for r in chat_rotation.texts(out).collect()}
    assert set(texts) == {(1, "ann_"), (1, "bob"), (1, "unknown"), (None, "x"), (3, "unknown")}
    text, spans = texts[1, "ann_"]
    assert text == (
        "<|assistant|>\nbefore<|end|>\n<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\nwho<|end|>\n"
    )
    assert [text[a:b] for a, b in spans] == ["before", "hi"]
    assert [texts[1, "unknown"][0][a:b] for a, b in texts[1, "unknown"][1]] == ["who"]
    assert [r["position"] for r in out.where("conv_id = 1 AND perspective = 'bob'").orderBy("position").collect()] == list(range(6))
    assert chat_rotation.segments(df.where("false")).collect() == []


def test_pipeline_stage_by_stage(spark, sf_dir, documents):
    """Each stage against its definition, on what its predecessor kept."""
    docs, benchmark = documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = queries.staged(stage(spark, docs, sf_dir), "test")
        after = {r["doc_id"]: r for r in out.collect()}
        if name != names[-1]:
            assert out.columns == documents.columns
        if name == "n-gram Jaccard join":
            want = brute_components(before, 5, 8, 10)
            assert set(after) == {k for k, c in want.items() if k == c}
        if name == "benchmark decontamination":
            dirty = {d for d, _ in brute_matches(before, [tuple(r) for r in benchmark.select("item_id", "text").collect()])}
            assert set(after) == {k for k, _ in before} - dirty
        if name in (names[1], names[4]):
            assert set(after) == {k for k, _ in before}
        docs = out


def test_pipeline_stages_nasty(spark, nasty, no_docs, sf_dir):
    for docs in (nasty, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = queries.staged(stage(spark, docs, sf_dir), "test")
            assert docs.columns == nasty.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_rotation_tells_apart_speakers_of_one_name(spark):
    rows = [(1, 0, "Ann B", "x"), (1, 1, "ann_b", "y"), (1, 2, "Ann B", "z"), (1, 3, "system", "s"), (2, 0, "ann_b", "alone"), (None, 0, "??", "p"), (None, 1, "!!", "q")]
    out = chat_rotation.segments(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    got = {(r["conv_id"], r["perspective"], r["content"]): (r["role"], r["name"], r["mask"]) for r in out}
    assert {k[:2] for k in got} == {(1, "ann_b"), (1, "ann_b#2"), (2, "ann_b"), (None, "_"), (None, "_#2")} and len(got) == len(out) == 13
    assert got[1, "ann_b", "x"] == got[1, "ann_b", "z"] == got[1, "ann_b#2", "y"] == ("assistant", None, 1)
    assert got[1, "ann_b", "y"] == ("user", "ann_b#2", 0) and got[1, "ann_b#2", "z"] == ("user", "ann_b", 0) and got[1, "ann_b", "s"] == ("system", None, 0)


def test_rotation_of_one_conversation_without_turn_numbers(spark, tmp_path):
    """Most rows are one conversation's, without or with equal numbers: spread over blocks of bounded size, equal to SQL."""
    rows = spark.range(6_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 40).cast("long").alias("conv_id"),
        F.when(F.col("id") % 2 > 0, F.lit(4)).cast("long").alias("turn"),
        F.concat(F.lit("p"), F.col("id") % 5).alias("role"),
        F.concat(F.repeat(F.lit("same beginning "), 4), F.col("id") % 1_500).alias("text"),
    )
    rows.write.parquet(f"{tmp_path}/c")
    before = len(session._staged_paths)
    out = chat_rotation.segments(spark.read.parquet(f"{tmp_path}/c"))
    numbered = [spark.read.parquet(p) for p in session._staged_paths[before:] if "/turns-" in p]
    sizes = numbered[0].groupBy("key", F.floor(F.col("at") / chat_rotation.BLOCK)).count()
    assert sizes.agg(F.max("count")).first()[0] <= chat_rotation.BLOCK
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    rel = con.execute(chat_rotation.ORACLE)
    columns = [d[0] for d in rel.description]
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
