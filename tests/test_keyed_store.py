"""The keyed store against a plain dictionary, its files after changes, failures and repeats."""

import glob
import os
import random

import pytest

from askloom.operators.keyed_store import KeyedStore
from askloom.session import staging_path

SCHEMA = "k string, at long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(store):
    return sorted((tuple(r) for r in store.table().collect()), key=repr)


def files(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/data/**/*.parquet", recursive=True)}


def applied(held, rows):
    """Brute force: greatest order wins, stored rows win ties, within a batch the greatest row."""
    batch = {}
    for k, at, v in rows:
        if k is not None:
            rank = (at is not None, at or 0, v is not None, v or "")
            if k not in batch or rank > batch[k][0]:
                batch[k] = rank, (k, at, v)
    for k, (_, row) in batch.items():
        old = held.get(k)
        if old is None or (row[1] is not None and (old[1] is None or row[1] > old[1])):
            held[k] = row


def test_random_batches_equal_a_dictionary(spark):
    rnd = random.Random(5)
    store, held = KeyedStore(spark, staging_path(spark, "store"), SCHEMA, "k", "at", 4), {}
    for n in (60, 1, 40):
        rows = [(rnd.choice([None, "", *(f"k{i}" for i in range(50))]), rnd.choice([None, -1, 0, 1, 2, 3]), rnd.choice([None, "", "a", "b"])) for _ in range(n)]
        store.upsert(frame(spark, rows))
        applied(held, rows)
        assert content(store) == sorted(held.values(), key=repr)
    gone = ["k1", "k2", "", "absent", "k1"]
    store.delete(frame(spark, [(k, 0, None) for k in gone]))
    held = {k: row for k, row in held.items() if k not in gone}
    assert content(store) == sorted(held.values(), key=repr)
    store.merge()
    assert content(store) == sorted(held.values(), key=repr)
    assert len(store.pieces()) <= 4
    asked = store.lookup(frame(spark, [("k3", 0, ""), ("k1", 0, ""), (None, 0, "")])).collect()
    assert [tuple(r) for r in asked] == [held[k] for k in ["k3"] if k in held]


def test_only_pieces_with_changed_keys_are_replaced(spark):
    store = KeyedStore(spark, staging_path(spark, "store"), SCHEMA, "k", "at", 8)
    store.upsert(frame(spark, [(f"k{i}", 1, "a") for i in range(200)]))
    before = files(store)
    assert store.upsert(frame(spark, [(f"new{i}", 1, "b") for i in range(200)])) == []
    replaced = store.upsert(frame(spark, [("k7", 2, "c")]))
    assert len(replaced) == 1
    after = files(store)
    assert all(after[f] == stamp for f, stamp in before.items())
    assert len(set(store.table().inputFiles())) < len(after)
    assert store.delete(frame(spark, [("absent", 1, "")])) == []
    assert store.table().count() == 400


def test_a_change_that_fails_or_is_repeated_changes_nothing_else(spark, monkeypatch):
    store = KeyedStore(spark, staging_path(spark, "store"), SCHEMA, "k", "at", 2)
    store.upsert(frame(spark, [("a", 1, "x"), ("b", 1, "x")]))
    batch = frame(spark, [("a", 2, "y"), ("c", 1, "x")])
    with monkeypatch.context() as broken:

        def lost(*_):
            raise OSError("lost")

        broken.setattr(type(batch), "coalesce", lost)
        with pytest.raises(OSError):
            store.upsert(batch)
    assert content(store) == [("a", 1, "x"), ("b", 1, "x")]
    for _ in range(2):
        store.upsert(batch)
        assert content(store) == [("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x")]


def test_empty_batches_whole_deletion_and_clashing_columns(spark):
    store = KeyedStore(spark, staging_path(spark, "store"), SCHEMA, "k", "at", 2)
    assert content(store) == [] and store.merge() == []
    store.upsert(frame(spark, []))
    assert content(store) == []
    odd = spark.createDataFrame([("a", 1, 9, 9, "s")], "k string, at int, part int, _stored int, segment string")
    store.upsert(odd)
    assert content(store) == [("a", 1, None)]
    store.delete(frame(spark, [("a", 0, None)]))
    assert content(store) == [] and store.lookup(frame(spark, [("a", 0, None)])).count() == 0


def test_one_key_with_most_rows(spark):
    store = KeyedStore(spark, staging_path(spark, "store"), SCHEMA, "k", "at", 4)
    rows = spark.range(60_000).selectExpr("if(id % 3 > 0, 'hot', concat('k', id)) AS k", "id AS at", "cast(id AS string) AS v")
    store.upsert(rows)
    assert store.table().count() == 20_001
    assert store.table().filter("k = 'hot'").collect()[0]["at"] == 59_999
