"""Nested records and drifting files against walks in plain Python."""

import json

from pyspark.sql import functions as F

from strandloom.operators import drift, nested
from strandloom.plans import core_queries

ROWS = [
    (1, 10, {"eventId": "a", "source": {"connector": "c"}, "payload": {"x": [{"y": [{"z": 1}, None, {"z": 2}]}, 3, [{"w": 1}]], "s": '[{"q":"[{}]"}]', "t": "[draft] no"}, "actors": {"id": "one"}, "subjects": [{"id": "s"}]}),
    (2, 10, {"eventId": "b", "payload": None, "actors": None, "extra": {"deep": [{"not": "walked"}]}}),
    (3, 20, {"eventId": "c", "source": {"connector": "c"}, "payload": {"xs": [{"y": "now text"}], "s": 5, "new": {"below": 1}, "t": None}, "extra": {"deep": 2}}),
    (4, 30, {"eventId": "d", "payload": '{"alone": true}'}),
]


def rows(spark):
    data = [(a, b, json.dumps(o)) for a, b, o in ROWS] + [(5, 10, None), (6, 10, "{"), (7, 10, "[]")]
    return spark.createDataFrame(data, "arrival bigint, batch_id bigint, raw string")


def test_elements(spark):
    got = {(r["arrival"], r["child_path"], r["parent_path"]) for r in nested.elements(rows(spark)).collect()}
    assert got == {
        (1, "payload.x[0]", "$"), (1, "payload.x[0].y[0]", "payload.x[0]"), (1, "payload.x[0].y[2]", "payload.x[0]"), (1, "payload.x[2][0]", "$"),
        (1, "payload.s[0]", "$"), (1, "payload.s[0].q[0]", "payload.s[0]"), (1, "actors[0]", "$"), (1, "subjects[0]", "$"), (3, "payload.xs[0]", "$"),
    }
    assert nested.elements(rows(spark).limit(0)).count() == 0


def test_flat_tables(spark):
    """Each table has a row an element, its parent's path, its position, typed columns, and what does not fit in rescued."""
    events = rows(spark)
    found = {(r["table_path"], r["parent_table"], r["field_name"], r["json_type"], r["n"]) for r in nested.catalogue(events).collect()}
    assert ("payload.x[].y[]", "payload.x[]", "z", "number", 2) in found and ("payload.s[]", "$", "q", "string", 1) in found and ("actors[]", "$", "id", "string", 1) in found
    assert ("payload.s[].q[]", "payload.s[]", None, None, 1) in found  # an object without fields
    tables = nested.flat_tables(events)
    assert sorted(tables) == sorted({t for t, *_ in found})
    got = {t: [tuple(r) for r in df.orderBy("arrival", "child_path").collect()] for t, df in tables.items()}
    assert got["payload.x[].y[]"] == [(1, "payload.x[0].y[0]", "payload.x[0]", 0, 1.0, None), (1, "payload.x[0].y[2]", "payload.x[0]", 2, 2.0, None)]
    assert got["actors[]"] == [(1, "actors[0]", "$", 0, "one", None)] and got["payload.xs[]"] == [(3, "payload.xs[0]", "$", 0, "now text", None)]
    assert got["payload.x[][]"] == [(1, "payload.x[2][0]", "$", 0, 1.0, None)] and got["payload.s[].q[]"] == [(1, "payload.s[0].q[0]", "payload.s[0]", 0, None)]
    odd = nested.flat_table(events, "payload.x[].y[]", {"z": "boolean", "position": "string"}).orderBy("child_path").collect()
    assert [(r["z"], r["position"], r["position_"], r["rescued"]) for r in odd] == [(None, 0, None, '{"z":1}'), (None, 2, None, '{"z":2}')]
    assert nested.flat_table(events, "payload.no[].such[]", {"a": "string"}).count() == 0


def test_deeper_than_one_pass(spark):
    deep: object = {"end": 1}
    for _ in range(9):
        deep = {"a": [deep]}
    raw = spark.createDataFrame([(1, json.dumps({"payload": deep}))], "arrival bigint, raw string")
    found = nested.elements(raw).collect()
    assert len(found) == 9 and max(len(r["child_path"]) for r in found) == len("payload" + ".a[0]" * 9)


def test_changes_and_rescue(spark):
    got = {tuple(r) for r in drift.changes(rows(spark)).select("batch_id", "field_path", "change_kind", "new_path").collect()}
    assert got == {(20, "payload.x", "renamed", "payload.xs"), (20, "payload.s", "type_changed", ""), (20, "payload.new", "added", "")}
    targets = [drift.Target("s", "s", "string"), drift.Target("flag", "alone", "boolean")]
    table = drift.ingest(rows(spark), targets)
    by = {r["arrival"]: r for r in table.collect()}
    assert (by[3]["s"], by[4]["flag"], by[4]["rescued"]["payload"]) == ("5", True, None)
    assert json.loads(by[2]["rescued"]["record"]) == ROWS[1][2]["extra"] | {} or json.loads(by[2]["rescued"]["record"]) == {"extra": ROWS[1][2]["extra"]}
    more = drift.promote(table, [drift.Target("t", "t", "string")])
    assert {r["arrival"]: r["t"] for r in more.where(F.col("t").isNotNull()).collect()} == {1: "[draft] no"}


def test_consistent_table(spark, tmp_path):
    """Renamed fields come out under one column, whichever field they are; a name counts per connector and from its file on."""
    def record(arrival, batch, connector, payload, **top):
        return arrival, batch, json.dumps({"eventId": str(arrival), "source": {"connector": connector}, "payload": payload, **top})

    data = [
        record(1, 10, "c", {"score": 1.5, "checksum": "x"}, traceId="t1"), record(2, 20, "c", {"rating": 2.5, "checksum": "y"}, trace_id="t2"),
        record(3, 30, "c", {"rating": 3.5, "extra": '{"a": 1}'}, trace_id="t3"), record(4, 40, "c", {"score_v2": 4.5, "extra": {"a": 2}}, trace_id="t4"),
        record(5, 15, "d", {"rating": 9, "checksum": 7}), record(6, 25, "d", {"rating": "8", "checksum": "z", "isDraft": True}),
        record(7, 35, "d", {"rating": 7, "checksum": [1]}),
    ]
    spark.createDataFrame(data, "arrival bigint, batch_id bigint, raw string").write.parquet(f"{tmp_path}/raw_events.parquet")
    by = {r["arrival"]: r.asDict(recursive=True) for r in core_queries.p4_table(spark, tmp_path).collect()}
    assert [by[i]["trace_id"] for i in range(1, 5)] == ["t1", "t2", "t3", "t4"]
    assert [by[i]["score"] for i in range(1, 5)] == [1.5, 2.5, 3.5, 4.5] and by[5]["score"] is None
    assert [by[i]["rating"] for i in (1, 2, 5, 6, 7)] == [None, None, 9, 8, 7]
    assert [by[i]["checksum"] for i in (1, 2, 5, 6, 7)] == ["x", "y", "7", "z", None] and json.loads(by[7]["rescued"]["payload"]) == {"checksum": [1]}
    assert json.loads(by[3]["extra"]) == {"a": 1} and by[6]["is_draft"] is True
    assert all(by[i]["rescued"] == {"record": None, "payload": None} for i in range(1, 5))


def test_all_types_of_a_field(spark):
    """A type between the smallest and the largest name is a type too."""
    data = [(10, "a", ["array", "number", "string", "null"]), (20, "a", ["array", "string"]), (20, "b", ["null"]), (30, "a", ["string", "object", "boolean", "number", "array"])]
    records = spark.createDataFrame([(b, "c", [(f, t)]) for b, f, ts in data for t in ts], "batch_id bigint, connector string, rows array<struct<field_path:string,type:string>>")
    fields, files = drift.file_fields(records)
    assert {tuple(r) for r in fields.collect()} == {(10, "a", "array|number|string"), (20, "a", "array|string"), (20, "b", None), (30, "a", "array|boolean|number|object|string")}
    changed = drift.compared(fields, files).where("change_kind = 'type_changed'").collect()
    assert {(r["batch_id"], r["field_path"]) for r in changed} == {(20, "a"), (30, "a")}


def test_two_names_in_one_record(spark):
    """The name that is not picked stays in rescued; a name that another connector gave means nothing here."""
    payloads = [(1, 10, {"score": 1, "rating": 2}), (2, 10, {"score": "none", "rating": 3}), (3, 20, {"score": 4, "rating": 5}), (4, 10, {"rating": 6, "scoreValue": 7})]
    raw = spark.createDataFrame([(a, b, json.dumps({"payload": p})) for a, b, p in payloads], "arrival bigint, batch_id bigint, raw string")
    names = spark.createDataFrame([(10, {"payload.rating": "payload.score", "payload.scoreValue": "payload.score"})], "batch_id bigint, names map<string,string>")
    ingested = drift.ingest(raw, [drift.Target("score", "score", "number")], names)
    promoted = drift.promote(drift.ingest(raw, [], names), [drift.Target("score", "score", "number")], names)
    for table in (ingested, promoted):
        got = {r["arrival"]: (r["score"], json.loads(r["rescued"]["payload"])) for r in table.collect()}
        assert got == {1: (1, {"rating": 2}), 2: (3, {"score": "none"}), 3: (4, {"rating": 5}), 4: (6, {"scoreValue": 7})}
