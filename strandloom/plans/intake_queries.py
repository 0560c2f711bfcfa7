"""Queries of the intake engine over deliveries made from the events table, and their equivalents in SQL.

Each row of events becomes a delivery, every fifth is delivered twice, and fixed parts are spoiled in each way the engine
must notice. The SQL works out from the columns what must come of it, without reading any JSON.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from strandloom.functions import canonical as C
from strandloom.functions.rfc3339 import parse_ms
from strandloom.operators import audit, intake
from strandloom.operators.normalize import Clock, Options, mapping_resolver, renormalize, verdicts
from strandloom.operators.ordering import with_running_sums
from strandloom.operators.payloads import AGENT_SPECS, EXAMPLE_SPECS, Check, PayloadSpec, Registry
from strandloom.session import passing, scratch, table
from strandloom.sources import agent_events, readers
from strandloom.sources.stores import AuditQuery, ObservationQuery, ReadApi, RefMatch, Stores, ref_bridge, select_audit, select_observations

START = 1_782_950_400_000
_CHECKS = (Check("k", "integer"), Check("userId", "integer"), Check("tag", "string", True))
SPECS = tuple(PayloadSpec(f"user.{t}", "1.0", f"User{t.capitalize()}", _CHECKS) for t in ("signup", "click", "view", "purchase"))
OPTIONS = Options(specs=SPECS, clock=Clock(START, 0))


def deliveries(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    ts = F.col("ts").cast("timestamp")
    iso = lambda t, tail: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(tail))
    occurred = F.when(n % 7 == 2, iso(ts, "")).when(n % 17 == 1, iso(ts + F.expr("interval 10 hours"), "+10:00")).otherwise(iso(ts, "Z"))
    q = F.lit('"')
    raw = F.concat(
        F.lit('{"eventId":"'), F.when(n % 23 == 7, "").otherwise(F.concat(F.lit("evt-"), n.cast("string"))), F.lit('","envelopeVersion":"'), F.when(n % 13 == 4, "9.9").otherwise("1.0"),
        F.lit('","schemaVersion":"'), F.when(n % 11 == 3, "2.0").otherwise("1.0"), F.lit('","kind":"user.'), F.col("event_type"), F.lit('","occurredAt":"'), occurred,
        F.lit('","payload":{"userId":'), F.col("user_id").cast("string"), F.lit(',"k":'), F.when(n % 19 == 6, F.concat(q, k, q)).otherwise(k),
        F.when(n % 3 == 0, F.concat(F.lit(',"tag":"t-'), (n % 10).cast("string"), q)).otherwise(""), F.lit(',"other":true},"source":{"system":"events"'),
        F.when(n % 2 == 0, ',"version":"7"').otherwise(""), F.lit('},"actors":[{"type":"user","id":"u'), F.col("user_id").cast("string"), F.lit('"}],"subjects":[{"type":"event_type","id":"'), F.col("event_type"), F.lit('"}]}'),
    )
    times = F.when(n % 5 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    return e.select(n.alias("n"), raw.alias("raw"), F.explode(times).alias("late")).select((F.col("n") * 10 + F.col("late")).alias("arrival"), "raw")


_RUN: dict[tuple, intake.Batch] = {}


def forget() -> None:
    """Drop what is kept of processed batches."""
    _RUN.clear()


def _batch(spark, d, name="plain", **changes):
    """The processed deliveries of ``d``. Many queries read one and the same batch, whose tables lie in the shared folder.
    name: of the changes, which are always the same under it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _RUN:
        _RUN[key] = intake.process(deliveries(spark, d), replace(OPTIONS, **changes)).kept()
    return _RUN[key]


def _session(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---- decisions ----
def ingest_status_counts(spark, d):
    _session(spark)
    return intake.status_counts(_batch(spark, d).results)


def ingest_results(spark, d):
    _session(spark)
    return _batch(spark, d).results.select("arrival", "status", "event_id", "reason", "message", "id", "type", "winner")


def skip_unknown_kind(spark, d):
    _session(spark)
    return verdicts(deliveries(spark, d), replace(OPTIONS, unknown_kind="skip")).groupBy("status").agg(F.count("*").alias("n"))


def rejection_reason_counts(spark, d):
    _session(spark)
    return verdicts(deliveries(spark, d), OPTIONS).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def rejection_issues(spark, d):
    _session(spark)
    bad = verdicts(deliveries(spark, d), OPTIONS).where(F.size("issues") > 0)
    return bad.select("arrival", F.posexplode("issues").alias("place", "i")).select("arrival", "place", F.col("i.path").alias("path"), F.col("i.message").alias("message"))


def redelivery_winners(spark, d):
    _session(spark)
    r = _batch(spark, d).results
    return r.where("status = 'duplicate'").select("arrival", "winner", "id")


# ---- observations ----
def observations_canonical(spark, d):
    _session(spark)
    o = _batch(spark, d).accepted
    return o.select(
        "id", "type", F.col("at").alias("at_ms"), "ingested_at", F.col("actors")[0]["id"].alias("actor_id"), F.col("subjects")[0]["id"].alias("subject_id"), "attributes",
        F.col("source.system").alias("system"), F.col("source.version").alias("source_version"), "source_event_id", F.col("versions.source").alias("version_source"), "insert_seq",
    )


def observation_integrity(spark, d):
    _session(spark)
    return _batch(spark, d).accepted.select("id", "integrity")


def integrity_keyed(spark, d):
    _session(spark)
    secret = "obs-key"
    o = _batch(spark, d, "integrity key", integrity_secret=secret).accepted
    return o.agg(F.count("*").alias("n"), F.count_if(C.verified(secret)).alias("good"), F.count_if(C.verified("other")).alias("good_other"), F.count_if(C.verified(None)).alias("good_plain"))


def verify_tampered(spark, d):
    _session(spark)
    o = _batch(spark, d).accepted
    edited = o.withColumn("attributes", F.when(F.col("insert_seq") % 10 == 3, F.regexp_replace("attributes", '"k":', '"k":1')).otherwise(F.col("attributes")))
    return edited.select("id", C.verified().alias("ok"))


def stepped_clock(spark, d):
    _session(spark)
    b = _batch(spark, d, "stepped", clock=Clock(START, 3))
    return b.accepted.select("id", "ingested_at")


def refs_bridge(spark, d):
    _session(spark)
    return ref_bridge(_batch(spark, d).accepted)


def resolver_mapping(spark, d):
    _session(spark)
    known = {("event_type", "click"): ("gesture", "press"), ("user", "u7"): ("person", "seven")}
    o = _batch(spark, d, "mapping", resolver=mapping_resolver(known)).accepted
    return ref_bridge(o).groupBy("role", "ref_type").agg(F.count("*").alias("n"), F.count_distinct("ref_id").alias("ids"))


def resolver_table(spark, d):
    """Refs resolved through a table inside the intake: users that are customers become members of their nations."""
    _session(spark)
    c = table(spark, d, "customer")
    known = c.select(F.lit("user").alias("ref_type"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("ref_id"), F.lit("nation").alias("to_type"), F.col("c_nationkey").cast("string").alias("to_id"))
    o = _batch(spark, d, "table", resolver_table=known).accepted
    return ref_bridge(o).where("role = 'actor'").groupBy("ref_type", "ref_id").agg(F.count("*").alias("n"))


# ---- timestamps and text ----
def _time_cases():
    """(text, strict ms, lenient ms): every field at its limit and beyond, by Python's own calendar."""
    base = {"day": "2024-02-28", "t": "T", "time": "12:30:30", "fraction": "", "offset": "Z"}
    days = ["2023-02-28", "2023-02-29", "2024-02-29", "2024-02-30", "1900-02-29", "2000-02-29", "2024-01-31", "2024-01-32", "2024-04-30", "2024-04-31", "2024-12-31", "2024-13-01", "2024-00-10", "2024-03-00", "9999-12-31", "1969-12-31"]
    varied = {
        "day": days, "t": ["t", " ", ""], "time": ["00:00:00", "23:59:59", "24:00:00", "23:60:00", "23:59:60", "7:05:00", "07:05"], "fraction": [".0", ".0004", ".0005", ".9995", ".123456789", "."],
        "offset": ["z", "+00:00", "-00:00", "+23:59", "-23:59", "+24:00", "+10:60", "+0530", "", "Z\n"],
    }
    out = []
    for field, values in varied.items():
        for v in values:
            c = base | {field: v}
            text, strict, lenient = "".join(c.values()), None, None
            sign, zone = (-1 if c["offset"].startswith("-") else 1), re.fullmatch(r"[+-](\d\d):(\d\d)", c["offset"])
            try:
                at = datetime.fromisoformat(f"{c['day']} {c['time']}")
                plain = re.fullmatch(r"\d\d:\d\d:\d\d", c["time"]) and c["t"] in "Tt" and c["t"] and c["fraction"] != "."
                offset = 0 if c["offset"] in ("Z", "z", "") else sign * (int(zone[1]) * 60 + int(zone[2])) if zone and int(zone[1]) < 24 and int(zone[2]) < 60 else None
                if plain and offset is not None:
                    ms = ((at - datetime(1970, 1, 1)).days * 86_400 + (at - datetime(1970, 1, 1)).seconds) * 1000 + int(Decimal("0" + (c["fraction"] or ".0")) * 1000 + Decimal("0.5")) - offset * 60_000
                    strict, lenient = (None if c["offset"] == "" else ms), ms
            except ValueError:
                pass
            if strict is not None or c["offset"] == "" or field in ("day", "fraction") or (field == "offset" and v in ("+24:00", "+10:60")):
                out.append((text, strict, lenient))
    return [*out, ("2024-02-28", None, 1709078400000), ("not-a-date", None, None), ("", None, None)]


def parse_rfc3339(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    _session(spark)
    forms = [F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), F.concat(F.date_format(F.col("t") - F.expr("interval 210 minutes"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:30")), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")]
    return e.select("event_id", *[parse_ms(f).alias(f"ms{i}") for i, f in enumerate(forms)])


def timestamp_cases(spark, d):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(_time_cases())], "n int, t string")
    return rows.select("n", parse_ms(F.col("t")).alias("strict_ms"), parse_ms(F.col("t"), "lenient").alias("lenient_ms"))


def stable_stringify(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit('{"z":'), F.get_json_object("props", "$.k"), F.lit(', "b" : ["x", null, true], "a":{"d":"'), F.col("event_type"), F.lit('","c":'), F.col("event_id").cast("string"), F.lit("}}"))
    return e.select("event_id", C.exact(F.to_json(F.try_parse_json(text))).alias("text"))


_NUMBERS = {
    "1541815603606036480": "1541815603606036500", "1152921504606846976": "1152921504606847000", "9007199254740993": "9007199254740992", "1e21": "1e+21", "1e20": "100000000000000000000", "5e-324": "5e-324", "1e-7": "1e-7",
    "0.000001": "0.000001", "-0": "0", "-0.0": "0", "1.0": "1", "1.10": "1.1", "100.0": "100", "12345678.123456789": "12345678.12345679", '"1e5 \\\\u000B"': '"1e5 \\\\u000B"', '"\\u001f\\u0041\\n"': '"\\u001fA\\n"', '"é\\u2028/"': '"é\u2028/"',
    "[1e400,-1e400]": "[null,null]", '{"b":1e400,"a":2}': '{"a":2}', '{"Infinity":"Infinity"}': '{"Infinity":"Infinity"}',
}


def stable_stringify_numbers(spark, d):
    """Numbers and escapes whose canonical text differs from how they are written, as a json field of a payload."""
    _session(spark)
    raws = [
        (i, '{"eventId":"e%d","envelopeVersion":"1.0","schemaVersion":"1.0","kind":"agent.action","occurredAt":"2026-07-01T09:30:00Z","payload":{"action":"a","detail":%s}}' % (i, t))
        for i, t in enumerate(_NUMBERS)
    ]
    judged = verdicts(spark.createDataFrame(raws, "arrival bigint, raw string"), Options(specs=AGENT_SPECS, clock=Clock(START)))
    return judged.select("arrival", F.col("attributes").alias("text"))


def envelope_issues(spark, d):
    """Several faults in one envelope are all listed, in the envelope's order."""
    _session(spark)
    n = F.col("event_id")
    part = lambda every, good, bad="": F.when(n % every == 0, bad).otherwise(good)
    raw = F.concat(
        F.lit('{"kind":"user.click","envelopeVersion":"1.0"'), part(2, ',"eventId":"e"'), part(3, ',"schemaVersion":"1.0"', ',"schemaVersion":1'), part(5, ',"occurredAt":"2026-07-01T09:30:00Z"', ',"occurredAt":""'),
        part(11, ',"payload":null'), part(7, "", ',"actors":"x"'), part(13, "", ',"subjects":[{"type":"t","id":"i"},{"type":"t","id":2,"attributes":[]},null]'), part(17, "", ',"source":{"system":5,"connector":"c"}'), F.lit("}"),
    )
    bad = verdicts(table(spark, d, "events").select(n.alias("arrival"), raw.alias("raw")), OPTIONS).where("reason = 'MALFORMED_ENVELOPE'")
    return bad.select("arrival", F.posexplode("issues").alias("place", "i")).select("arrival", "place", F.col("i.path").alias("path"), F.col("i.message").alias("message"))


def payload_issues(spark, d):
    """Faults of a bundled schema's fields, in the order of its checks."""
    _session(spark)
    n = F.col("event_id")
    raw = F.concat(
        F.lit('{"eventId":"e","envelopeVersion":"1.0","schemaVersion":"1.0","kind":"deploy.finished","occurredAt":"2026-07-01T09:30:00Z","payload":{"status":'), F.when(n % 2 == 0, '"failed"').otherwise('"odd"'),
        F.when(n % 3 == 0, "").when(n % 3 == 1, ',"service":null').otherwise(',"service":"s"'), F.when(n % 5 == 0, ',"environment":""').otherwise(',"environment":"e"'),
        F.when(n % 7 == 0, ',"durationMs":1.5').when(n % 7 == 1, ',"durationMs":"1"').when(n % 7 == 2, ',"durationMs":1e2').otherwise(""), F.lit("}}"),
    )
    judged = verdicts(table(spark, d, "events").select(n.alias("arrival"), raw.alias("raw")), Options(specs=EXAMPLE_SPECS, clock=Clock(START)))
    return judged.select("arrival", F.posexplode_outer("issues").alias("place", "i")).select("arrival", "place", F.col("i.path").alias("path"), F.col("i.message").alias("message"))


# ---- audit ----
def audit_trail(spark, d):
    _session(spark)
    return _batch(spark, d).trail.select("sequence", "stage", "outcome", "event_id", "observation_id", F.col("at").alias("at_ms"), "detail")


def audit_stage_counts(spark, d):
    _session(spark)
    return _batch(spark, d).trail.groupBy("stage", "outcome").agg(F.count("*").alias("n"))


def audit_skipped(spark, d):
    """Events of unknown kind that are skipped leave one record each, and the sequence goes on over them."""
    _session(spark)
    trail = _batch(spark, d, "skip", unknown_kind="skip").trail
    return trail.where("outcome = 'skipped'").select("sequence", "stage", "event_id", "detail")


def audit_chain_head(spark, d):
    _session(spark)
    return audit.tail(_batch(spark, d).trail).select("sequence", "hash")


def _broken(spark, d, change):
    _session(spark)
    t = _batch(spark, d).trail
    return audit.verify_chain(change(t))


def audit_verify_intact(spark, d):
    return _broken(spark, d, lambda t: t)


def audit_verify_edit(spark, d):
    return _broken(spark, d, lambda t: t.withColumn("stage", F.when(F.col("sequence") == 20, "edited").otherwise(F.col("stage"))))


def audit_verify_delete(spark, d):
    return _broken(spark, d, lambda t: t.where("sequence <> 30"))


def audit_verify_reorder(spark, d):
    swap = F.when(F.col("sequence") == 11, 12).when(F.col("sequence") == 12, 11).otherwise(F.col("sequence"))
    _session(spark)
    t = _batch(spark, d).trail.withColumn("listed", swap)
    return audit.verify_chain(t, position="listed")


def audit_verify_forge(spark, d):
    def forge(t):
        edited = t.withColumn("stage", F.when(F.col("sequence") == 40, "edited").otherwise(F.col("stage")))
        return edited.withColumn("hash", F.when(F.col("sequence") == 40, C.digest(audit.record_json(F.col("previous_hash")), None)).otherwise(F.col("hash")))

    return _broken(spark, d, forge)


def audit_keyed(spark, d):
    _session(spark)
    t = _batch(spark, d, "audit key", audit_secret="s3").trail
    return audit.verify_chain(t, "s3").withColumn("key", F.lit("right")).unionByName(audit.verify_chain(t).withColumn("key", F.lit("none")))


def event_audit(spark, d):
    _session(spark)
    return select_audit(_batch(spark, d).trail, AuditQuery(event_id="evt-5")).select("sequence", "stage", "outcome")


def audit_by_stage(spark, d):
    _session(spark)
    return select_audit(_batch(spark, d).trail, AuditQuery(stage="dedupe", limit=25)).select("sequence", "outcome", "event_id")


def audit_by_observation(spark, d):
    """The trail of the first stored observation: what accepted it, and its redeliveries."""
    _session(spark)
    b = _batch(spark, d)
    one = b.accepted.orderBy("insert_seq").first()["id"]
    return select_audit(b.trail, AuditQuery(observation_id=one)).select("sequence", "stage", "outcome")


def audit_ndjson(spark, d):
    _session(spark)
    return audit.ndjson(_batch(spark, d).trail).select("sequence", F.regexp_replace("line", r',"(previousHash|hash)":"[^"]*"', "").alias("line"))


# ---- reading ----
def _query(spark, d, q):
    _session(spark)
    found = select_observations(_batch(spark, d).accepted, q).select("id", F.col("at").alias("at_ms"), "at", "insert_seq")
    sign = 1 if q.order == "asc" else -1
    keys = F.struct((F.col("at") * sign).alias("a"), (F.col("insert_seq") * sign).alias("b"))
    return with_running_sums(found.select("id", "at_ms", keys.alias("k")), "k", {"before": 1}).select((F.col("before") + 1).alias("place"), "id", "at_ms")


def query_all(spark, d):
    return _query(spark, d, ObservationQuery())


def query_types(spark, d):
    return _query(spark, d, ObservationQuery(types=("UserClick", "UserView")))


def query_no_types(spark, d):
    return _query(spark, d, ObservationQuery(types=()))


def query_time_window(spark, d):
    return _query(spark, d, ObservationQuery(from_ms=1_705_000_000_000, to_ms=1_710_000_000_000))


def query_actor(spark, d):
    return _query(spark, d, ObservationQuery(actor=RefMatch("u7")))


def query_actor_typed(spark, d):
    return _query(spark, d, ObservationQuery(actor=RefMatch("u7", "team")))


def query_subject(spark, d):
    return _query(spark, d, ObservationQuery(subject=RefMatch("click", "event_type")))


def query_and(spark, d):
    return _query(spark, d, ObservationQuery(types=("UserClick",), actor=RefMatch("u7", "user"), from_ms=0))


def query_desc_limit(spark, d):
    return _query(spark, d, ObservationQuery(order="desc", limit=50))


def query_tie_break(spark, d):
    """Many observations at one time: the order of storing decides, reversed with the order."""
    _session(spark)
    tied = _batch(spark, d).accepted.withColumn("at", F.col("at") - F.pmod("at", F.lit(1_000_000_000)))
    found = select_observations(tied, ObservationQuery(order="desc", limit=200)).select("id", "at", "insert_seq")
    keys = F.struct((-F.col("at")).alias("a"), (-F.col("insert_seq")).alias("b"))
    return with_running_sums(found.select("id", keys.alias("k")), "k", {"before": 1}).select((F.col("before") + 1).alias("place"), "id")


def query_limit_zero(spark, d):
    return _query(spark, d, ObservationQuery(limit=0))


def count_observations(spark, d):
    _session(spark)
    return _batch(spark, d).accepted.agg(F.count("*").alias("n"))


def observation_types(spark, d):
    return spark.createDataFrame([(t,) for t in Registry(SPECS).observation_types()], "type string")


# ---- durable stores ----
def _stored(spark, d):
    """The processed deliveries in a durable store, under two normalization versions."""
    _session(spark)
    s, b = Stores(spark, scratch(spark, "stored")), _batch(spark, d)
    n = s.put(b.accepted.drop("arrival"))
    s.append_audit(b.trail)
    later, _ = renormalize(deliveries(spark, d), replace(OPTIONS, normalization_version="2.0"))
    once = later.groupBy("id").agg(F.min_by(F.struct(*later.columns), "arrival").alias("o")).select("o.*")
    s.put(with_running_sums(once, "arrival", {"place": 1}).select(*[c for c in once.columns if c != "arrival"], (F.col("place") + n).alias("insert_seq")))
    return s


def coexisting_versions(spark, d):
    return _stored(spark, d).query().groupBy(F.col("versions.normalization").alias("version")).agg(F.count("*").alias("n"), F.max("insert_seq").alias("last"))


def get_and_has_observation(spark, d):
    """Lookups of a stored id and of one that is not, and the last audit record, through the read side."""
    s = _stored(spark, d)
    read = ReadApi(s, [])
    one = _batch(spark, d).accepted.orderBy("insert_seq").first()["id"]
    found = read.get_observation(one).select("id", F.col("at").alias("at_ms"))
    return found.select("*", F.lit(read.has_observation(one)).alias("has"), F.lit(read.has_observation("obs_none")).alias("has_other")).crossJoin(s.audit_tail().select(F.col("sequence").alias("tail")))


def stored_twice(spark, d):
    """The same deliveries taken in twice: the second time every valid one is a duplicate, and one chain spans both."""
    _session(spark)
    engine = intake.Intake(spark, OPTIONS)
    with passing(spark):  # the first results are not asked for
        engine.ingest(deliveries(spark, d), "first")
    second = engine.ingest(deliveries(spark, d), "second")
    again = engine.ingest(deliveries(spark, d), "second")
    chain = audit.verify_chain(engine.stores.table("audit"))
    counts = second.agg(F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    n = engine.read.count_observations()
    return counts.crossJoin(chain.select("ok", F.col("length").alias("records"))).withColumn("stored", F.lit(n).cast("bigint")).withColumn("repeated", F.lit(again.count()).cast("bigint"))


def duplicate_results(spark, d):
    """Duplicates return the stored original: its ingested_at, not the later delivery's."""
    _session(spark)
    engine = intake.Intake(spark, replace(OPTIONS, clock=Clock(START, 1)))
    results = engine.ingest(deliveries(spark, d))
    return engine.observations_of(results).where("status = 'duplicate'").select("arrival", "id", "source_event_id", "ingested_at")


def _archived(spark, d):
    s = Stores(spark, scratch(spark, "archive"))
    s.archive(deliveries(spark, d), START)
    return s


def archive_replay(spark, d):
    return _archived(spark, d).replay().select("sequence", "received_at", F.get_json_object("event", "$.eventId").alias("event_id"))


def archive_replay_from_limit(spark, d):
    return _archived(spark, d).replay(100, 20).select("sequence")


def archive_prune(spark, d):
    s = _archived(spark, d)
    gone = s.prune_before(150)
    return s.replay().agg(F.count("*").alias("left"), F.min("sequence").alias("first")).withColumns({"gone": F.lit(gone).cast("bigint"), "counted": F.lit(s.count_archive()).cast("bigint")})


def renormalize_v2(spark, d):
    _session(spark)
    events = deliveries(spark, d)
    obs, _ = renormalize(events, replace(OPTIONS, normalization_version="2.0"))
    return obs.select("arrival", "id")


def renormalize_rejections(spark, d):
    _session(spark)
    _, bad = renormalize(deliveries(spark, d), replace(OPTIONS, normalization_version="2.0", unknown_kind="skip"))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def to_evidence(spark, d):
    _session(spark)
    e = intake.evidence(_batch(spark, d).accepted)
    return e.select("kind", F.col("subject")[0]["id"].alias("subject_id"), F.col("actor.id").alias("actor_id"), "content", F.col("provenance.source").alias("source"), F.col("provenance.at").alias("at_text"), "id")


# ---- sources ----
def agent_tool_called(spark, d):
    e = table(spark, d, "events")
    built = agent_events.tool_calls(
        e.select(F.col("event_id").alias("arrival"), F.concat(F.lit("tool-"), "event_type").alias("tool"), F.when(F.col("event_id") % 2 == 0, F.lit("srv")).alias("server"), F.col("props").alias("args"),
                 F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("agent_id"), F.lit("2026-07-01T09:30:00.000Z").alias("occurred_at"))
    )
    r = intake.process(built, Options(specs=AGENT_SPECS, clock=Clock(START))).results
    return r.where("status = 'accepted'").groupBy("type", F.col("actors")[0]["type"].alias("actor_type"), F.col("subjects")[0]["id"].alias("tool")).agg(F.count("*").alias("n"), F.min("attributes").alias("least"))


def agent_action(spark, d):
    e = table(spark, d, "events")
    built = agent_events.actions(e.select(F.col("event_id").alias("arrival"), F.col("event_type").alias("action"), F.lit("ok").alias("status"), F.lit("2026-07-01T10:00:00.000Z").alias("occurred_at")))
    r = intake.process(built, Options(specs=AGENT_SPECS, clock=Clock(START))).results
    return r.groupBy("status", "type").agg(F.count("*").alias("n"))


def orders_as_issues(spark, d):
    """Orders as issue.opened events through the bundled schema; priorities it doesn't know are refused."""
    o = table(spark, d, "orders")
    p = F.lower(F.regexp_extract("o_orderpriority", r"([A-Z]+)\z", 1))
    raw = F.to_json(F.struct(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("eventId"), F.lit("1.0").alias("envelopeVersion"), F.lit("1.0").alias("schemaVersion"), F.lit("issue.opened").alias("kind"),
        F.concat(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("occurredAt"),
        F.struct(F.col("o_orderkey").cast("string").alias("issue"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("title"), p.alias("priority")).alias("payload")))
    judged = verdicts(o.select(F.col("o_orderkey").alias("arrival"), raw.alias("raw")), Options(specs=EXAMPLE_SPECS, clock=Clock(START)))
    return judged.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def ndjson_source(spark, d):
    """Raw texts written as NDJSON with blank lines and read back as events."""
    _session(spark)
    path = scratch(spark, "ndjson")
    deliveries(spark, d).select(F.explode(F.array("raw", F.lit("  "))).alias("value")).write.text(path)
    return readers.read_events(spark, path).agg(F.count("*").alias("n"), F.count_distinct("raw").alias("texts"))


def array_source(spark, d):
    """Raw texts written as one JSON array and read back; the place in the array is the arrival."""
    _session(spark)
    path = scratch(spark, "array")
    raws = deliveries(spark, d).where("arrival < 10000").orderBy("arrival").agg(F.collect_list(F.struct("arrival", "raw")).alias("r"))
    texts = F.transform(F.array_sort("r"), lambda x: x["raw"])
    raws.select(F.concat(F.lit(" \t["), F.array_join(texts, ",\n"), F.lit("]")).alias("value")).write.text(path)
    back = readers.read_events(spark, path)
    return back.select("arrival", F.get_json_object("raw", "$.eventId").alias("event_id"))


_LOCAL_NAMES = ("deliveries", "forget")
QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k not in _LOCAL_NAMES}

_BASE = """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events),
    x AS (SELECT e.*, l.late, event_id * 10 + l.late AS arrival FROM e, (VALUES (0), (5)) AS l(late) WHERE l.late = 0 OR event_id % 5 = 0),
    j AS (SELECT *, CASE WHEN event_id % 23 = 7 THEN 'MALFORMED_ENVELOPE' WHEN event_id % 13 = 4 THEN 'UNSUPPORTED_ENVELOPE_VERSION'
                         WHEN event_type NOT IN ('signup', 'click', 'view', 'purchase') THEN 'UNKNOWN_KIND' WHEN event_id % 11 = 3 THEN 'SCHEMA_VERSION_MISMATCH'
                         WHEN event_id % 19 = 6 THEN 'INVALID_PAYLOAD' WHEN event_id % 7 = 2 THEN 'INVALID_TIMESTAMP' END AS reason,
                 'User' || upper(event_type[1]) || event_type[2:] AS otype,
                 CASE WHEN event_id % 23 <> 7 THEN 'evt-' || event_id END AS eid,
                 strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS iso,
                 '{"k":' || k || CASE WHEN event_id % 3 = 0 THEN ',"tag":"t-' || (event_id % 10) || '"' ELSE '' END || ',"userId":' || user_id || '}' AS attributes FROM x),
    r AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN late = 0 THEN 'accepted' ELSE 'duplicate' END AS status,
                 CASE WHEN reason IS NULL THEN 'obs_' || sha256('["' || eid || '","' || otype || '","1.0"]') END AS oid FROM j),
    a AS (SELECT *, row_number() OVER (ORDER BY arrival) - 1 AS seq FROM r WHERE status = 'accepted')
"""
_TEXT = """'{"actors":[{"id":"u' || user_id || '","type":"user"}],"at":' || ms || ',"attributes":' || attributes || ',"id":"' || oid || '","ingestedAt":1782950400000,"source":{"system":"events"'
    || CASE WHEN event_id % 2 = 0 THEN ',"version":"7"' ELSE '' END || '},"sourceEventId":"' || eid || '","subjects":[{"id":"' || event_type || '","type":"event_type"}],"type":"' || otype
    || '","versions":{"envelope":"1.0","normalization":"1.0","schema":"1.0"' || CASE WHEN event_id % 2 = 0 THEN ',"source":"7"' ELSE '' END || '}}'"""
_MESSAGE = """CASE reason WHEN 'MALFORMED_ENVELOPE' THEN 'event envelope is malformed' WHEN 'UNSUPPORTED_ENVELOPE_VERSION' THEN 'unsupported envelopeVersion "9.9"; supported: 1.0'
    WHEN 'UNKNOWN_KIND' THEN 'no validator registered for kind "user.' || event_type || '"'
    WHEN 'SCHEMA_VERSION_MISMATCH' THEN 'kind "user.' || event_type || '" has no validator for schemaVersion "2.0"; known: 1.0'
    WHEN 'INVALID_PAYLOAD' THEN 'payload failed validation for kind "user.' || event_type || '"'
    WHEN 'INVALID_TIMESTAMP' THEN 'occurredAt "' || iso || '" must be an RFC 3339 timestamp with a timezone offset (e.g. a trailing "Z")' END"""
_TRAIL = (
    _BASE
    + f""", m AS (SELECT *, {_MESSAGE} AS message FROM r),
    i AS (SELECT *, CASE reason WHEN 'MALFORMED_ENVELOPE' THEN ',"x":[{{"message":"must be a non-empty string","path":"eventId"}}]'
                    WHEN 'INVALID_PAYLOAD' THEN ',"x":[{{"message":"must be a finite number","path":"payload.k"}}]' ELSE '' END AS iss FROM m),
    p AS (SELECT * FROM (VALUES ('accepted', 0, 'validation', 'passed'), ('accepted', 1, 'normalization', 'passed'), ('accepted', 2, 'attribution', 'passed'), ('accepted', 3, 'dedupe', 'unique'),
              ('accepted', 4, 'storage', 'stored'), ('duplicate', 0, 'validation', 'passed'), ('duplicate', 1, 'dedupe', 'duplicate'),
              ('rejected', 0, 'validation', 'failed'), ('rejected', 1, 'rejection', 'rejected')) AS p(status, kk, stage, outcome)),
    t AS (SELECT row_number() OVER (ORDER BY arrival, kk) - 1 AS sequence, stage, outcome, coalesce(eid, '<unknown>') AS event_id, oid AS observation_id, 1782950400000 AS at_ms,
                 CASE WHEN stage = 'attribution' THEN '{{"actors":1,"subjects":1}}' WHEN outcome = 'failed' THEN '{{"reason":"' || reason || '"}}'
                      WHEN outcome = 'rejected' THEN '{{' || CASE WHEN iss <> '' THEN '"issues":' || iss[6:] || ',' ELSE '' END || '"message":"' || replace(message, '"', '\\"') || '","reason":"' || reason || '"}}' END AS detail
          FROM i JOIN p USING (status))
"""
)
_READS = """, c AS (SELECT *, coalesce(sum(CASE status WHEN 'accepted' THEN 6 WHEN 'duplicate' THEN 3 ELSE 2 END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reads FROM r)
"""
_MS_OR_NULL = lambda v: "NULL" if v is None else str(v)
_NOT_TEXT = "must be a non-empty string"
_ENVELOPE = [
    ("eventId", _NOT_TEXT, "event_id % 2 = 0"), ("schemaVersion", _NOT_TEXT, "event_id % 3 = 0"), ("occurredAt", _NOT_TEXT, "event_id % 5 = 0"), ("payload", "is required", "event_id % 11 = 0"),
    ("actors", "must be an array when present", "event_id % 7 = 0"), ("subjects[1].id", _NOT_TEXT, "event_id % 13 = 0"), ("subjects[1].attributes", "must be an object", "event_id % 13 = 0"),
    ("subjects[2]", "must be an object", "event_id % 13 = 0"), ("source.system", "must be a string when present", "event_id % 17 = 0"),
]
_PAYLOAD = [
    ("payload.service", "is required", "event_id % 3 = 0"), ("payload.service", _NOT_TEXT, "event_id % 3 = 1"), ("payload.environment", _NOT_TEXT, "event_id % 5 = 0"),
    ("payload.status", "must be one of: succeeded, failed", "event_id % 2 = 1"), ("payload.durationMs", "must be an integer", "event_id % 7 = 0"), ("payload.durationMs", "must be a finite number", "event_id % 7 = 1"),
]
_ISSUES = lambda rules, join: f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}', '{m}')" for i, (p, m, _) in enumerate(rules))}) AS k(o, path, message)),
    x AS (SELECT event_id, k.* FROM events, k WHERE CASE o {" ".join(f"WHEN {i} THEN {c}" for i, (_, _, c) in enumerate(rules))} END),
    y AS (SELECT event_id, path, message, row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS place FROM x)
    SELECT e.event_id AS arrival, CAST(place AS INTEGER) AS place, path, message FROM events e {join} JOIN y USING (event_id)"""  # noqa: E731
_FIND = lambda where, order="ms, seq", limit="": _BASE + f"SELECT row_number() OVER (ORDER BY {order}) AS place, oid AS id, ms AS at_ms FROM a WHERE {where} ORDER BY {order} {limit}"
_CHAIN = lambda ok, length, at, why: f"SELECT {ok} AS ok, {length} AS length, CAST({at} AS BIGINT) AS broken_at, CAST({why} AS VARCHAR) AS reason FROM t LIMIT 1"

ORACLES = {
    "ingest_status_counts": _BASE + "SELECT s.status, count(r.status) AS n FROM (VALUES ('accepted'), ('duplicate'), ('rejected'), ('skipped')) AS s(status) LEFT JOIN r USING (status) GROUP BY ALL",
    "ingest_results": _BASE + f"SELECT arrival, status, eid AS event_id, reason, {_MESSAGE} AS message, oid AS id, CASE WHEN reason IS NULL THEN otype END AS type, CASE WHEN reason IS NULL THEN event_id * 10 END AS winner FROM r",
    "skip_unknown_kind": _BASE + "SELECT CASE WHEN reason IS NULL THEN 'valid' WHEN reason = 'UNKNOWN_KIND' THEN 'skipped' ELSE 'rejected' END AS status, count(*) AS n FROM r GROUP BY ALL",
    "rejection_reason_counts": _BASE + "SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "rejection_issues": _BASE + "SELECT arrival, 0 AS place, CASE reason WHEN 'INVALID_PAYLOAD' THEN 'payload.k' ELSE 'eventId' END AS path, CASE reason WHEN 'INVALID_PAYLOAD' THEN 'must be a finite number' ELSE 'must be a non-empty string' END AS message FROM r WHERE reason IN ('INVALID_PAYLOAD', 'MALFORMED_ENVELOPE')",
    "redelivery_winners": _BASE + "SELECT arrival, event_id * 10 AS winner, oid AS id FROM r WHERE status = 'duplicate'",
    "observations_canonical": _BASE + "SELECT oid AS id, otype AS type, ms AS at_ms, 1782950400000 AS ingested_at, 'u' || user_id AS actor_id, event_type AS subject_id, attributes, 'events' AS system, CASE WHEN event_id % 2 = 0 THEN '7' END AS source_version, eid AS source_event_id, CASE WHEN event_id % 2 = 0 THEN '7' END AS version_source, seq AS insert_seq FROM a",
    "observation_integrity": _BASE + f"SELECT oid AS id, sha256({_TEXT}) AS integrity FROM a",
    "integrity_keyed": _BASE + "SELECT count(*) AS n, count(*) AS good, CAST(0 AS BIGINT) AS good_other, CAST(0 AS BIGINT) AS good_plain FROM a",
    "verify_tampered": _BASE + "SELECT oid AS id, seq % 10 <> 3 AS ok FROM a",
    "stepped_clock": _BASE + _READS + "SELECT oid AS id, CAST(1782950400000 + 3 * reads AS BIGINT) AS ingested_at FROM c WHERE status = 'accepted'",
    "refs_bridge": _BASE + "SELECT oid AS observation_id, 'actor' AS role, 'user' AS ref_type, 'u' || user_id AS ref_id FROM a UNION ALL SELECT oid, 'subject', 'event_type', event_type FROM a",
    "resolver_mapping": _BASE + ", b AS (SELECT 'actor' AS role, CASE WHEN user_id = 7 THEN 'person' ELSE 'user' END AS ref_type, CASE WHEN user_id = 7 THEN 'seven' ELSE 'u' || user_id END AS ref_id FROM a UNION ALL SELECT 'subject', CASE WHEN event_type = 'click' THEN 'gesture' ELSE 'event_type' END, CASE WHEN event_type = 'click' THEN 'press' ELSE event_type END FROM a) SELECT role, ref_type, count(*) AS n, count(DISTINCT ref_id) AS ids FROM b GROUP BY ALL",
    "resolver_table": _BASE + "SELECT CASE WHEN c_nationkey IS NULL THEN 'user' ELSE 'nation' END AS ref_type, coalesce(CAST(c_nationkey AS VARCHAR), 'u' || user_id) AS ref_id, count(*) AS n FROM a LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL",
    "timestamp_cases": "SELECT CAST(n AS INTEGER) AS n, CAST(s AS BIGINT) AS strict_ms, CAST(l AS BIGINT) AS lenient_ms FROM (VALUES " + ", ".join(f"({i}, {_MS_OR_NULL(s)}, {_MS_OR_NULL(x)})" for i, (_, s, x) in enumerate(_time_cases())) + ") AS t(n, s, l)",
    "stable_stringify_numbers": "SELECT CAST(n AS BIGINT) AS arrival, '{\"action\":\"a\",\"detail\":' || t || '}' AS text FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_NUMBERS.values())) + ") AS t(n, t)",
    "envelope_issues": _ISSUES(_ENVELOPE, ""),
    "payload_issues": _ISSUES(_PAYLOAD, "LEFT"),
    "query_tie_break": _BASE + "SELECT row_number() OVER (ORDER BY ms - ms % 1000000000 DESC, seq DESC) AS place, oid AS id FROM a ORDER BY ms - ms % 1000000000 DESC, seq DESC LIMIT 200",
    "coexisting_versions": _BASE + ", s AS (SELECT count(*) AS n FROM a) SELECT v AS version, n, CAST(n * k - 1 AS BIGINT) AS last FROM s, (VALUES ('1.0', 1), ('2.0', 2)) AS v(v, k)",
    "get_and_has_observation": _TRAIL + "SELECT oid AS id, ms AS at_ms, true AS has, false AS has_other, (SELECT max(sequence) FROM t) AS tail FROM a WHERE seq = 0",
    "archive_replay": _BASE + "SELECT row_number() OVER (ORDER BY arrival) - 1 AS sequence, 1782950400000 AS received_at, coalesce(eid, '') AS event_id FROM r",
    "array_source": _BASE + "SELECT row_number() OVER (ORDER BY arrival) - 1 AS arrival, coalesce(eid, '') AS event_id FROM r WHERE arrival < 10000",
    "parse_rfc3339": "SELECT event_id, CAST(floor(epoch_us(ts) / 1000.0 + 0.5) AS BIGINT) AS ms0, epoch_us(ts) // 1000000 * 1000 AS ms1, CAST(NULL AS BIGINT) AS ms2 FROM events",
    "stable_stringify": "SELECT event_id, '{\"a\":{\"c\":' || event_id || ',\"d\":\"' || event_type || '\"},\"b\":[\"x\",null,true],\"z\":' || json_extract_string(props, '$.k') || '}' AS text FROM events",
    "audit_trail": _TRAIL + "SELECT * FROM t",
    "audit_skipped": _BASE + f""", m AS (SELECT *, {_MESSAGE} AS message, CASE WHEN reason = 'UNKNOWN_KIND' THEN 'skipped' ELSE status END AS st FROM r),
        q AS (SELECT *, coalesce(sum(CASE st WHEN 'accepted' THEN 5 WHEN 'skipped' THEN 1 ELSE 2 END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
        SELECT CAST(before AS BIGINT) AS sequence, 'validation' AS stage, coalesce(eid, '<unknown>') AS event_id, '{{"message":"' || replace(message, '"', '\\"') || '","reason":"UNKNOWN_KIND"}}' AS detail FROM q WHERE st = 'skipped'""",
    "audit_stage_counts": _TRAIL + "SELECT stage, outcome, count(*) AS n FROM t GROUP BY ALL",
    "audit_chain_head": _TRAIL + """, c AS (SELECT sequence, '{"at":1782950400000,' || CASE WHEN detail IS NOT NULL THEN '"detail":' || detail || ',' ELSE '' END || '"eventId":"' || event_id || '","id":"rec-' || sequence || '",'
          || CASE WHEN observation_id IS NOT NULL THEN '"observationId":"' || observation_id || '",' ELSE '' END || '"outcome":"' || outcome || '","previousHash":"' AS head,
          '","sequence":' || sequence || ',"stage":"' || stage || '"}' AS tail FROM t)
        SELECT max(sequence) AS sequence, list_reduce(list_prepend('genesis', list(head || chr(1) || tail ORDER BY sequence)), lambda h, x: sha256(replace(x, chr(1), h))) AS hash FROM c""",
    "audit_verify_intact": _TRAIL + _CHAIN("true", "(SELECT count(*) FROM t)", "NULL", "NULL"),
    "audit_verify_edit": _TRAIL + _CHAIN("false", "CAST(NULL AS BIGINT)", "20", "'bad_hash'"),
    "audit_verify_delete": _TRAIL + _CHAIN("false", "CAST(NULL AS BIGINT)", "30", "'bad_sequence'"),
    "audit_verify_reorder": _TRAIL + _CHAIN("false", "CAST(NULL AS BIGINT)", "11", "'bad_sequence'"),
    "audit_verify_forge": _TRAIL + _CHAIN("false", "CAST(NULL AS BIGINT)", "41", "'broken_link'"),
    "audit_keyed": _TRAIL + "SELECT true AS ok, count(*) AS length, CAST(NULL AS BIGINT) AS broken_at, CAST(NULL AS VARCHAR) AS reason, 'right' AS key FROM t UNION ALL SELECT false, NULL, CAST(0 AS BIGINT), 'bad_hash', 'none'",
    "event_audit": _TRAIL + "SELECT sequence, stage, outcome FROM t WHERE event_id = 'evt-5'",
    "audit_by_stage": _TRAIL + "SELECT sequence, outcome, event_id FROM t WHERE stage = 'dedupe' ORDER BY sequence LIMIT 25",
    "audit_by_observation": _TRAIL + "SELECT sequence, stage, outcome FROM t WHERE observation_id = (SELECT oid FROM a WHERE seq = 0)",
    "audit_ndjson": _TRAIL + """SELECT sequence, '{"id":"rec-' || sequence || '","stage":"' || stage || '","outcome":"' || outcome || '","eventId":"' || event_id || '","at":1782950400000,"sequence":' || sequence
        || CASE WHEN observation_id IS NOT NULL THEN ',"observationId":"' || observation_id || '"' ELSE '' END || CASE WHEN detail IS NOT NULL THEN ',"detail":' || detail ELSE '' END || '}' AS line FROM t""",
    "query_all": _FIND("true"),
    "query_types": _FIND("otype IN ('UserClick', 'UserView')"),
    "query_no_types": _FIND("false"),
    "query_time_window": _FIND("ms >= 1705000000000 AND ms < 1710000000000"),
    "query_actor": _FIND("user_id = 7"),
    "query_actor_typed": _FIND("false"),
    "query_subject": _FIND("event_type = 'click'"),
    "query_and": _FIND("event_type = 'click' AND user_id = 7"),
    "query_desc_limit": _FIND("true", "ms DESC, seq DESC", "LIMIT 50"),
    "query_limit_zero": _FIND("false"),
    "count_observations": _BASE + "SELECT count(*) AS n FROM a",
    "observation_types": "SELECT unnest(['UserClick', 'UserPurchase', 'UserSignup', 'UserView']) AS type",
    "stored_twice": _BASE + "SELECT count(*) FILTER (status <> 'rejected') AS duplicates, CAST(0 AS BIGINT) AS accepted, true AS ok, CAST(sum(CASE status WHEN 'accepted' THEN 5 ELSE 2 END) + 2 * count(*) AS BIGINT) AS records, count(*) FILTER (status = 'accepted') AS stored, CAST(0 AS BIGINT) AS repeated FROM r",
    "duplicate_results": _BASE + _READS + "SELECT d.arrival, d.oid AS id, d.eid AS source_event_id, CAST(1782950400000 + o.reads AS BIGINT) AS ingested_at FROM c d JOIN c o ON o.oid = d.oid AND o.status = 'accepted' WHERE d.status = 'duplicate'",
    "archive_replay_from_limit": "SELECT unnest(range(100, 120)) AS sequence",
    "archive_prune": _BASE + "SELECT count(*) - 150 AS left, CAST(150 AS BIGINT) AS first, CAST(150 AS BIGINT) AS gone, count(*) - 150 AS counted FROM r",
    "renormalize_v2": _BASE + "SELECT arrival, 'obs_' || sha256('[\"' || eid || '\",\"' || otype || '\",\"2.0\"]') AS id FROM r WHERE reason IS NULL",
    "renormalize_rejections": _BASE + "SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "to_evidence": _BASE + "SELECT 'observation:' || otype AS kind, event_type AS subject_id, 'u' || user_id AS actor_id, attributes AS content, 'events' AS source, iso || 'Z' AS at_text, oid AS id FROM a",
    "agent_tool_called": """WITH g AS (SELECT DISTINCT event_type, user_id, event_id % 2 AS odd, json_extract_string(props, '$.k') AS k FROM events)
        SELECT 'AgentToolCalled' AS type, 'agent' AS actor_type, 'tool-' || event_type AS tool, count(*) AS n,
               min('{"args":{"k":' || k || '},"protocol":"mcp",' || CASE WHEN odd = 0 THEN '"server":"srv",' ELSE '' END || '"tool":"tool-' || event_type || '"}') AS least FROM g GROUP BY event_type""",
    "agent_action": "SELECT 'accepted' AS status, 'AgentAction' AS type, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'duplicate', 'AgentAction', count(*) - count(DISTINCT event_type) FROM events",
    "orders_as_issues": """WITH o AS (SELECT lower(regexp_extract(o_orderpriority, '([A-Z]+)$', 1)) AS p FROM orders)
        SELECT CASE WHEN p IN ('low', 'medium', 'high') THEN 'valid' ELSE 'rejected' END AS status, CASE WHEN p IN ('low', 'medium', 'high') THEN '' ELSE 'INVALID_PAYLOAD' END AS reason, count(*) AS n FROM o GROUP BY ALL""",
    "ndjson_source": _BASE + "SELECT count(*) AS n, count(DISTINCT event_id) AS texts FROM r",
}
