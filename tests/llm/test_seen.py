"""Seen keys against brute force; filters that are kept, opened again and grown."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import seen
from strandloom.llm.ribbon import Ribbon
from strandloom.session import scratch

OBS = "id string, source_event_id string, insert_seq bigint"


def wanted(old, rows):
    want = set()
    for k, name in ((0, "id"), (1, "source_event_id")):
        known = {o[k] for o in old}
        for row in sorted(rows, key=lambda r: r[2]):
            if row[k] is not None:
                if row[k] in known:
                    want.add((row[2], name))
                known.add(row[k])
    return want


def data(n=300, seed=1):
    r = random.Random(seed)
    old = [(r.choice(["k%d" % r.randrange(30), None, ""]), r.choice(["e%d" % r.randrange(40), None])) for _ in range(20)]
    return old, [("hot" if i % 3 == 0 else r.choice(["k%d" % r.randrange(200), None, ""]), r.choice(["e%d" % r.randrange(200), "E1", None]), i * 7) for i in range(n)]


def test_ribbon_never_misses():
    rng = np.random.default_rng(3)
    for n in (0, 1, 700, 30_000):
        keys = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        f = Ribbon.unpack(Ribbon.build(keys).pack())
        assert f.contains(keys).all()
        assert f.contains(rng.integers(-(2**63), 2**63 - 1, 50_000, dtype=np.int64)).mean() < 0.002


def test_repeats(spark):
    old, rows = data()
    got = {tuple(x) for x in seen.repeats(spark.createDataFrame(old, "id string, source_event_id string"), spark.createDataFrame(rows, OBS)).select("insert_seq", "key_field").collect()}
    assert got == wanted(old, rows)
    empty = spark.createDataFrame([], OBS)
    assert seen.repeats(empty.drop("insert_seq"), empty).count() == 0


def test_kept_filters_open_again_and_grow(spark, monkeypatch):
    """A folder opened again goes on with its batches; finer shards are served by the coarser filters before them."""
    old, rows = data(240, 4)
    root = scratch(spark, "kept")
    first, second = spark.createDataFrame(rows[:120], OBS), spark.createDataFrame(rows[120:], OBS)
    filters = seen.KeyFilters(spark, root)
    filters.take(0, seen.key_rows(spark.createDataFrame(old, "id string, source_event_id string"), F.lit(-1)), 40)
    filters.take(1, seen.key_rows(first, F.col("insert_seq")), 240)
    monkeypatch.setattr(seen, "SHARD_KEYS", 20)
    again = seen.KeyFilters(spark, root)
    assert again.sealed == {0: 0, 1: 0}
    keys = seen.key_rows(second, F.col("insert_seq"))
    found = {r["h"] for r in again.take(2, keys, 240).collect()}
    assert again.sealed[2] == 3 and again.table([2]).select("shard").distinct().count() > 2
    asked = {(r["seq"], r["key_field"]): r["h"] for r in keys.collect()}
    late = {w for w in wanted(old, rows) if w[0] >= 120 * 7}
    assert all(asked[w] in found for w in late) and len(found) <= len({asked[w] for w in late}) + 3
    assert {r["h"] for r in again.take(2, keys.limit(0), 0).collect()} == found  # taken in once only


def test_a_batch_that_failed_is_sealed_again(spark):
    root = scratch(spark, "half")
    keys = seen.key_rows(spark.createDataFrame(data()[1], OBS), F.col("insert_seq"))
    filters = seen.KeyFilters(spark, root)
    filters.take(0, keys, 600)
    filters._files.delete("sealed/000000/_SUCCESS")
    again = seen.KeyFilters(spark, root)
    assert again.sealed == {}
    again.take(0, keys, 600)
    assert again.table().agg(F.sum("keys")).first()[0] == keys.select("key_field", "h").distinct().count()


def test_error_rates(spark):
    rows = spark.createDataFrame([(f"k{i}", f"e{i}", i) for i in range(3000)], OBS)
    rates = {(r["key_field"], r["gen"]): r for r in seen.error_rates(rows.drop("insert_seq").limit(500), rows, 2).collect()}
    assert sorted(rates) == [(f, g) for f in ("id", "source_event_id") for g in (0, 1, 2)]
    assert all(r["filters_probed"] == g and (r["wrong_rate"] is None) == (g == 0) for (_, g), r in rates.items())
    assert all(r["wrong_rate"] < 0.003 and r["audit_keys"] > 0 for (_, g), r in rates.items() if g)
    assert sum(r["keys"] for r in rates.values()) == 7000 and all(r["bits_per_key"] < 40 for r in rates.values())
