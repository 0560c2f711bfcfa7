"""Redelivery, late hours and features against brute force."""

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import features, late, redelivery
from strandloom.operators.skew import join_to_unique
from strandloom.session import scratch
from strandloom.streaming.ingest import exactly_once_stream, late_hours_stream


def test_redelivered(spark):
    ids = ["x", "x", "y", "", "x", "y", "z", "X"]
    raw = [(i * 10, '{"eventId":"%s"}' % v) for i, v in enumerate(ids)] + [(80, '{"eventId":"\\u0078"}'), (90, '{"eventId":5}'), (100, None), (110, "{"), (120, '{"eventId":5}')]
    df = spark.createDataFrame(raw, "arrival bigint, raw string")
    assert {tuple(r) for r in redelivery.redelivered(df).collect()} == {(0, 10), (0, 40), (20, 50), (0, 80)}
    assert redelivery.exactly_once(df).count() == len(raw) - 4
    assert redelivery.redelivered(df.limit(0)).count() == 0


def test_search_walks_equal_hashes():
    h = np.array([1, 5, 5, 5, 9])
    ids = np.array(["a", "b", "c", "d", "e"], object)
    assert redelivery.search(h, ids, np.array([5, 5, 1, 9, 10, 5]), np.array(["d", "zz", "a", "e", "e", "b"], object)).tolist() == [3, -1, 0, 4, -1, 1]


def test_hot_join(spark):
    rows = spark.createDataFrame([("h" if i % 2 else f"c{i}", i) for i in range(4000)], "k string, v int")
    unique = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    out = join_to_unique(rows, unique, "k", "n", 4000)
    assert out.count() == 4000 and out.where("k = 'h' and low = 1").count() == 2000


def test_late_hours(spark):
    h, base = 3_600_000, 1_742_000_400_000
    rows = [(1, base, base + 5), (2, base, base + h), (3, base, base + 49 * h), (4, base, base + 49 * h + 1), (5, None, base), (6, base, None), (7, base // 1000, base + h - 1), (2, base, base + h)]
    df = spark.createDataFrame(rows, "insert_seq bigint, observed_at bigint, ingested_at bigint")
    assert sorted(tuple(r) for r in late.late_rows(df).collect()) == [(2, "correction"), (2, "correction"), (3, "correction"), (4, "too_late")]
    assert [tuple(r) for r in late.corrected_hours(df).select("hour_start", "on_time", "corrections", "total").collect()] == [(base // h * h, 2, 3, 5)]


def test_late_hours_open_again(spark, monkeypatch):
    """A batch counts once however often it comes, whoever opened the folder; compaction and failed batches change nothing."""
    monkeypatch.setattr(late, "COMPACT_AT", 2)
    h, base = 3_600_000, 1_742_000_400_000
    hour, root = base // h * h, scratch(spark, "late")
    frame = lambda *rows: spark.createDataFrame(rows, "insert_seq bigint, event_ms bigint, ingested_at bigint")
    first, second, third = frame((1, base, base + 1)), frame((2, base, base + 2 * h), (3, base, base + 90 * h)), frame((4, base + 24 * h, base + 24 * h))
    late.LateHours(spark, root).ingest(first, 0)
    again = late.LateHours(spark, root)
    again.ingest(first, 0)
    second.write.parquet(f"{root}/retained/0-batch-000000001/part=1")  # left behind by a batch that failed
    again.ingest(second, 1)
    once_more = late.LateHours(spark, root)
    once_more.ingest(second, 1)
    once_more.ingest(third)
    want = {(hour, 1, 1, 2), (hour + 24 * h, 1, 0, 1)}
    for state in (once_more, late.LateHours(spark, root)):
        assert {tuple(r)[:4] for r in state.hours().collect()} == want
        assert sorted(tuple(r) for r in state.verdicts().collect()) == [(1, "on_time"), (2, "correction"), (3, "too_late"), (4, "on_time")]
    assert once_more.state["last"] == 2 and not once_more.state["done"]


def test_identifier_index_opens_again_and_grows(spark):
    root = scratch(spark, "index")
    frame = lambda ids, at: spark.createDataFrame([(v, at + i) for i, v in enumerate(ids)], "id string, arrival bigint")
    ids = [f"k{i}" for i in range(60)]
    batches = [frame(ids[:20] + ids[:5], 0), frame(ids[10:40], 100), frame(ids[35:60] + ["k0", ""], 200), frame(ids, 300)]
    seen: dict[str, int] = {}
    for number, batch in enumerate(batches):
        index = redelivery.IdentifierIndex(spark, root, prefix_keys=10)
        got = {(r["id"], r["kept"]) for r in index.ingest(batch, number).collect()}
        again = {(r["id"], r["kept"]) for r in redelivery.IdentifierIndex(spark, root).ingest(batch, number).collect()}
        rows, want = [r for r in batch.collect() if r["id"]], set()
        counts = {i: sum(r["id"] == i for r in rows) for i in {r["id"] for r in rows}}
        for i, n in counts.items():
            first = seen.setdefault(i, min(r["arrival"] for r in rows if r["id"] == i))
            if n > 1 or first < number * 100:
                want.add((i, first))
        assert got == again == want
    last = redelivery.IdentifierIndex(spark, root)
    assert last.state["next"] == 4 and max(r["bits"] for r in last.state["runs"]) >= 3 and sum(r["rows"] for r in last.state["runs"]) == 60


def test_streams_take_a_micro_batch_once(spark):
    state = late.LateHours(spark, scratch(spark, "late"))
    index = redelivery.IdentifierIndex(spark, scratch(spark, "ids"))
    source, sink = scratch(spark, "source"), scratch(spark, "sink")
    base = 1_742_000_400_000
    spark.createDataFrame([(1, "a", base, base), (2, "a", base, base)], "insert_seq bigint, id string, event_ms bigint, ingested_at bigint").write.parquet(source)
    for _ in range(2):  # the second time from a new checkpoint: all is delivered again
        stream = spark.readStream.schema("insert_seq bigint, id string, event_ms bigint, ingested_at bigint").parquet(source)
        late_hours_stream(state, stream.drop("id"), scratch(spark, "c"), once=True).awaitTermination()
        exactly_once_stream(index, stream.withColumnRenamed("insert_seq", "arrival").select("id", "arrival"), scratch(spark, "c"), sink, once=True).awaitTermination()
    assert [r["total"] for r in state.hours().collect()] == [2]
    assert [r["arrival"] for r in spark.read.parquet(sink).collect()] == [1]


def test_features(spark):
    schema = "id string, obs_type string, observed_at bigint, actors array<struct<ref_type:string,ref_id:string,attributes:string>>, attributes string, insert_seq bigint"
    a, b = ("user", "a", None), ("team", "a", None)
    rows = [("1", "T", 1742000400000, [a, a, b], '{"m":3}', 1), ("1", "T", 1742000500000, [a], '{"m":100}', 9), ("2", "T", 1742000400, [a], "{}", 2), ("3", "U", None, [a, (None, "q", None)], None, 3), ("4", "?", 1, [a], None, 4), ("5", "T", 5, None, "{", 5)]
    df = spark.createDataFrame(rows, schema)
    registry = spark.createDataFrame([("k", "T", "m"), ("l", "U", None), ("n", "V", "m")], "kind string, obs_type string, measure_field string")
    got = {(r["ref_type"], r["ref_id"]): r.asDict() for r in features.wide_features(df, registry).collect()}
    assert set(got) == {("user", "a"), ("team", "a")}
    u = got["user", "a"]
    assert (u["T_count"], u["T_latest"], u["T_total"], u["U_count"], u["U_latest"], u["V_count"]) == (2, 1742000400000, 3.0, 1, None, 0)
