"""The intake engine: golden hashes, decisions, stores, chain, streaming."""

import io
import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.conformance import CASES
from strandloom.functions import canonical as C
from strandloom.operators import audit, intake
from strandloom.operators.normalize import Clock, Options
from strandloom.operators.payloads import EXAMPLE_SPECS, Check, PayloadSpec, Registry
from strandloom.session import scratch
from strandloom.sources import readers, stores
from strandloom.sources.stores import AuditQuery, MemoryStores, Stores
from strandloom.streaming.ingest import ingest_stream, raw_stream

EVENT = {
    "eventId": "evt-1", "envelopeVersion": "1.0", "schemaVersion": "1.0", "kind": "review.submitted", "occurredAt": "2026-07-01T09:30:00.000Z", "source": {"system": "github", "version": "2022-11-28"},
    "payload": {"pullRequest": "pr#1", "decision": "approved"}, "actors": [{"type": "actor", "id": "alice"}], "subjects": [{"type": "pull_request", "id": "pr#1"}],
}
OPTIONS = Options(clock=Clock(1782950400000))
BAD = [
    ({"envelopeVersion": "9.9"}, "UNSUPPORTED_ENVELOPE_VERSION"), ({"kind": "mystery"}, "UNKNOWN_KIND"), ({"schemaVersion": "2.0"}, "SCHEMA_VERSION_MISMATCH"), ({"payload": None}, "INVALID_PAYLOAD"),
    ({"payload": {"pullRequest": "", "decision": "x", "comments": 1.5}}, "INVALID_PAYLOAD"), ({"occurredAt": "not-a-date"}, "INVALID_TIMESTAMP"), ({"actors": "alice"}, "MALFORMED_ENVELOPE"), ({"source": {"system": None}}, "MALFORMED_ENVELOPE"),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "arrival bigint, raw string")


def test_decisions_and_golden_hashes(spark):
    texts = [json.dumps(EVENT), json.dumps(EVENT), "{}", None, "nope"] + [json.dumps(EVENT | c) for c, _ in BAD]
    b = intake.process(frame(spark, texts), OPTIONS)
    rows = {r["arrival"]: r for r in b.results.collect()}
    assert [rows[i]["status"] for i in range(5)] == ["accepted", "duplicate", "rejected", "rejected", "rejected"]
    assert [rows[5 + i]["reason"] for i in range(len(BAD))] == [want for _, want in BAD]
    assert [i["path"] for i in rows[2]["issues"]] == ["eventId", "envelopeVersion", "schemaVersion", "kind", "occurredAt", "payload"]
    assert [(i["path"], i["message"]) for i in rows[9]["issues"]] == [("payload.pullRequest", "must be a non-empty string"), ("payload.decision", "must be one of: approved, changes_requested, commented"), ("payload.comments", "must be an integer")]
    o = b.accepted.first()
    assert o["id"] == "obs_eee93754848842ac1a7ced85763743cfb9782cea3f951b5880eb75a43fc7b6a5"
    assert o["integrity"] == "e367776e12cefd91861502e7ce5385b95ab7b560fb6b2ceca107a52ed2fa0e4f"
    assert audit.verify_chain(b.trail).first()["ok"]


def test_chain_golden(spark):
    rec = [("rec-0", "validation", "passed", "evt-1", "obs_eee93754848842ac1a7ced85763743cfb9782cea3f951b5880eb75a43fc7b6a5", 1782950400000, None, 0)]
    df = spark.createDataFrame(rec, "id string, stage string, outcome string, event_id string, observation_id string, at bigint, detail string, sequence bigint")
    assert audit.chained(df).first()["hash"] == "31b162e3678b34e765834cdd600b1dfabf2e0c28e7bf94eb1df6c08c5eb67546"


def test_canonical_numbers_and_paths(spark):
    numbers = (1.0, -0.0, 1e21, 1e-7, 0.1, 1e20, 5e-324, 123456789.125, 1e-6, float("inf"), float(1541815603606036480), float(2**60), -12.5)
    assert [C.number_text(x) for x in numbers] == ["1", "0", "1e+21", "1e-7", "0.1", "100000000000000000000", "5e-324", "123456789.125", "0.000001", "null", "1541815603606036500", "1152921504606847000", "-12.5"]
    texts = ['{"b":1e2,"a":"x\\u001f"}', '{"b":[1.10,true,null]}', '{"😀":1,"B":2,"a":{}}', '{"id":1541815603606036480}', '{"hash":"3e5 1.0","n":3}', '{"a":"\\\\u000B"}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.exact(F.to_json(F.try_parse_json("t")))).collect()
    assert [r[0] for r in got] == [C.canonical(json.loads(t)) for t in texts]
    strings = ['q"\\ \n\t', "\x00\x0b\x1f", "plain", "\x7f\u2028😀", None, ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in strings], "t string").select(C.quoted(F.col("t"))).collect()] == [None if t is None else C.canonical(t) for t in strings]


def test_numbers_beyond_doubles(spark):
    """Dropped from objects and null in arrays of a json field, an issue where the field itself is one, null in a ref's attributes."""
    call = EVENT | {"kind": "agent.tool_called", "payload": {"tool": "t", "args": {"a": "@", "b": ["@", 1], "Infinity": "Infinity"}}, "actors": [{"type": "a", "id": "b", "attributes": {"z": "@", "y": 1541815603606036480}}]}
    raws = [json.dumps(call).replace('"@"', "1e400"), json.dumps(call | {"payload": {"tool": "t", "args": "@"}}).replace('"@"', "-1e400"), json.dumps(call | {"payload": {"tool": "t", "args": {"__proto__": 1, "c": 2}}}).replace('"@"', "1")]
    rows = {r["arrival"]: r for r in intake.process(frame(spark, raws), OPTIONS).results.collect()}
    assert rows[0]["attributes"] == '{"args":{"Infinity":"Infinity","b":[null,1]},"tool":"t"}' and rows[0]["actors"][0]["attributes"] == '{"y":1541815603606036500,"z":null}'
    assert [tuple(i) for i in rows[1]["issues"]] == [("payload.args", "must be a JSON value")] and rows[2]["attributes"] == '{"args":{"c":2},"tool":"t"}'


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("kind", ["parquet", "memory"])
def test_conformance(spark, kind, name):
    CASES[name](lambda: Stores(spark, scratch(spark, "conformance")) if kind == "parquet" else MemoryStores(spark))


def test_stores(spark):
    engine = intake.Intake(spark, OPTIONS, keep_raw=True)
    engine.ingest(frame(spark, [json.dumps(EVENT), json.dumps(EVENT | {"eventId": "evt-2"})]))
    again = intake.Intake(spark, OPTIONS, engine.stores.root, keep_raw=True)
    assert [r["status"] for r in again.ingest(frame(spark, [json.dumps(EVENT)])).collect()] == ["duplicate"]
    assert again.read.count_observations() == 2 and again.stores.replay(1).count() == 2
    assert audit.verify_chain(again.stores.table("audit")).first()["ok"]
    assert again.read.query_audit(AuditQuery(event_id="evt-2")).count() == 5
    with pytest.raises(ValueError):
        Registry([*EXAMPLE_SPECS, EXAMPLE_SPECS[0]])


def test_a_batch_that_fails_anywhere_leaves_nothing(spark, monkeypatch):
    """After each write and before the commit: the batch repeated is archived once, audited once, and accepted."""
    engine = intake.Intake(spark, OPTIONS, keep_raw=True)
    batch = frame(spark, [json.dumps(EVENT), json.dumps(EVENT)])

    class Broken(Exception):
        pass

    for step in ("archived", "observations_put", "audit_appended", "_publish"):
        real = getattr(Stores, step)

        def fails(self, *a, real=real, step=step, **k):
            if step != "_publish":
                real(self, *a, **k)
            raise Broken

        monkeypatch.setattr(Stores, step, fails)
        with pytest.raises(Broken):
            engine.ingest(batch, "one")
        monkeypatch.setattr(Stores, step, real)
        engine = intake.Intake(spark, OPTIONS, engine.stores.root, keep_raw=True)
        assert engine.read.count_observations() == 0 and engine.read.query_audit().count() == 0 and engine.stores.count_archive() == 0 and not engine.stores.is_done("one")
    assert sorted(r["status"] for r in engine.ingest(batch, "one").collect()) == ["accepted", "duplicate"]
    assert engine.ingest(batch, "one").count() == 0
    assert (engine.stores.count_archive(), engine.read.query_audit().count(), engine.read.count_observations()) == (2, 7, 1)


def test_clock_goes_on_over_batches_and_archives(spark):
    engine = intake.Intake(spark, replace(OPTIONS, clock=Clock(1000, 1)), keep_raw=True)
    engine.ingest(frame(spark, [json.dumps(EVENT), "nope"]))  # archive, ingested_at, 5 records; archive, 2 records
    engine.ingest(frame(spark, [json.dumps(EVENT | {"eventId": "evt-2"})]))
    assert [r["received_at"] for r in engine.stores.replay().collect()] == [1000, 1007, 1010]
    assert [r["ingested_at"] for r in engine.read.query_observations().orderBy("insert_seq").collect()] == [1001, 1011]
    assert [r["at"] for r in engine.read.query_audit().collect()] == [*range(1002, 1007), 1008, 1009, *range(1012, 1017)]
    now = intake.Intake(spark, Options()).options.clock.at()
    assert abs(now.start - time.time() * 1000) < 60_000


def test_id_index_reads_touched_prefixes(spark, monkeypatch):
    monkeypatch.setattr(stores, "PREFIX_IDS", 10)
    s = Stores(spark, scratch(spark, "index"))
    ids = [f"obs_{i}" for i in range(300)]
    for k in range(0, 300, 30):
        s.commit(ids=s._indexed(spark.createDataFrame([(i,) for i in ids[k : k + 30]], "id string"), 30))
    assert len(s.state["ids"]) < 10 and max(r["bits"] for r in s.state["ids"]) == 5
    for few in (200_000, 1):
        monkeypatch.setattr(stores, "BROADCAST_IDS", few)
        assert sorted(r["id"] for r in s.known_among(spark.createDataFrame([(i,) for i in ("obs_7", "new", "obs_299")], "id string")).collect()) == ["obs_299", "obs_7"]


def test_validators_and_resolvers(spark):
    """A validator in Python, a computed attribute, and refs resolved through a table."""

    def even(payload):
        return {"n": payload["n"], "half": payload["n"] / 2} if isinstance(payload, dict) and payload.get("n", 1) % 2 == 0 else [("n", "must be even")]

    computed = (("twice", lambda p: (F.try_variant_get(p, "$.n", "bigint") * 2).cast("string")),)
    specs = (PayloadSpec("even", "1.0", "Even", validator=even), PayloadSpec("plain", "1.0", "Plain", (Check("n", "integer"),), computed))
    event = lambda i, kind, n, who: json.dumps(EVENT | {"eventId": f"v{i}", "kind": kind, "payload": {"n": n}, "actors": [{"type": "user", "id": who}, {"type": "user", "id": "x"}]})
    known = spark.createDataFrame([("user", "ann", "person", "7"), ("user", "ann", "person", "8"), ("user", None, "a", "b")], "ref_type string, ref_id string, to_type string, to_id string")
    options = replace(OPTIONS, specs=specs, resolver_table=known)
    b = intake.process(frame(spark, [event(0, "even", 4, "ann"), event(1, "even", 3, "ann"), event(2, "plain", 5, "bob")]), options)
    rows = {r["arrival"]: r for r in b.results.collect()}
    assert (rows[0]["attributes"], rows[2]["attributes"]) == ('{"half":2,"n":4}', '{"n":5,"twice":10}')
    assert [tuple(i) for i in rows[1]["issues"]] == [("payload.n", "must be even")]
    assert [[(a["type"], a["id"]) for a in rows[i]["actors"]] for i in (0, 2)] == [[("person", "7"), ("user", "x")], [("user", "bob"), ("user", "x")]]
    assert b.accepted.where(C.verified()).count() == 2


def test_readers_and_command_line(spark, tmp_path, monkeypatch, capsys):
    good, bad = json.dumps(EVENT), json.dumps(EVENT | {"eventId": "evt-2", "kind": "mystery"})
    array, lines, broken = tmp_path / "a.json", tmp_path / "b.ndjson", tmp_path / "c.ndjson"
    array.write_text(f" \t[{good},\n {good}, 5]\n")
    lines.write_text(f"\t\n{good}\r\n \u00a0\n\t{good}\t\n{bad}\n\n")
    broken.write_text(f"{good}\n\t\n{{\n")
    assert [r["raw"] for r in readers.read_events(spark, str(array)).orderBy("arrival").collect()][2] == "5"
    assert [r["arrival"] for r in readers.read_events(spark, str(lines)).orderBy("arrival").collect()] == [0, 1, 2]
    assert readers.events_of_text(spark, "").count() == 0
    assert cli.main([str(array)]) == 1 and "1 accepted, 1 duplicate, 1 rejected, 0 skipped" in capsys.readouterr().out
    assert cli.main([str(broken)]) == 2 and "invalid JSON on line 2" in capsys.readouterr().err
    monkeypatch.setattr("sys.stdin", io.StringIO(good))
    assert cli.main(["--json", "--audit"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert len(said["observations"]) == 1 and len(said["audit"]) == 5 and said["observations"][0]["ingested_at"] > 1_700_000_000_000


def test_stream(spark):
    """Files as they come; a micro-batch delivered again from a new checkpoint is a batch of duplicates under another name only."""
    path = scratch(spark, "stream-in")
    spark.createDataFrame([(json.dumps(EVENT),), (json.dumps(EVENT),), ("broken",)], "value string").coalesce(1).write.text(path)
    engine = intake.Intake(spark, OPTIONS)
    for _ in range(2):
        ingest_stream(engine, raw_stream(spark, path), scratch(spark, "stream-checkpoint"), once=True).awaitTermination()
        assert engine.read.count_observations() == 1 and engine.read.query_audit().count() == 9
    ingest_stream(engine, raw_stream(spark, path), scratch(spark, "stream-checkpoint"), "again", once=True).awaitTermination()
    assert engine.read.count_observations() == 1 and engine.read.query_audit().count() == 15
