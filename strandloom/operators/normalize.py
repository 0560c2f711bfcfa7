"""From raw event texts to verdicts: one canonical observation or one rejection per delivery, as a pure column program."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import canonical as C
from strandloom.functions import jsontext as J
from strandloom.functions.rfc3339 import parse_ms
from strandloom.operators.ordering import spread
from strandloom.operators.payloads import AGENT_SPECS, EXAMPLE_SPECS, PayloadSpec, Registry
from strandloom.operators.skew import join_to_unique
from strandloom.session import written

NORMALIZATION_VERSION = "1.0"
SUPPORTED_ENVELOPE_VERSIONS = ("1.0",)
UNKNOWN_EVENT = "<unknown>"

REF = "struct<type:string,id:string,attributes:string>"
ISSUES = "array<struct<path:string,message:string>>"


@dataclass(frozen=True)
class Clock:
    """The n-th read is start + n * step milliseconds; n counts from zero in order of arrival, over all batches of an engine.

    Without a start it is the system's clock, read once a batch: all of a batch's records carry that time.
    """

    start: int | None = None
    step: int = 0

    def at(self, reads: int = 0) -> Clock:
        """The clock for a batch before which it was read ``reads`` times."""
        return Clock(int(time.time() * 1000)) if self.start is None else Clock(self.start + reads * self.step, self.step)


def identity_resolver(ref: Column) -> Column:
    return ref


def mapping_resolver(known: dict[tuple[str, str], tuple[str, str]]) -> Callable[[Column], Column]:
    """Refs named in a small literal mapping take their new type and id; all others stay."""
    pairs = F.create_map(*[x for (t, i), (t2, i2) in known.items() for x in (F.lit(f"{t}\u0000{i}"), F.struct(F.lit(t2).alias("type"), F.lit(i2).alias("id")))])

    def resolve(ref: Column) -> Column:
        to = F.try_element_at(pairs, F.concat(ref["type"], F.lit("\u0000"), ref["id"]))
        return F.struct(F.coalesce(to["type"], ref["type"]).alias("type"), F.coalesce(to["id"], ref["id"]).alias("id"), ref["attributes"].alias("attributes"))

    return resolve


@dataclass(frozen=True)
class Options:
    """How events are judged. resolver: a column function of a ref. resolver_table: ref_type, ref_id, to_type, to_id of any size."""

    specs: tuple[PayloadSpec, ...] = (*EXAMPLE_SPECS, *AGENT_SPECS)
    normalization_version: str = NORMALIZATION_VERSION
    envelope_versions: tuple[str, ...] = SUPPORTED_ENVELOPE_VERSIONS
    timestamp_policy: str = "rfc3339"
    unknown_kind: str = "reject"
    resolver: Callable[[Column], Column] = identity_resolver
    resolver_table: DataFrame | None = None
    clock: Clock = field(default_factory=Clock)
    integrity_secret: str | bytes | None = None
    audit_secret: str | bytes | None = None


def _issue(path: str | Column, message: str, bad: Column) -> Column:
    return F.when(bad, F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(message).alias("message")))


def _not_text(v: Column) -> Column:
    return ~F.coalesce(J.is_string(v) & (F.try_variant_get(v, "$", "string") != ""), F.lit(False))


def _get(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, path, kind)


def _ref_issues(doc: Column, name: str) -> Column:
    whole, items = _get(doc, f"$.{name}"), _get(doc, f"$.{name}", "array<variant>")

    def of(r: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
        plain = J.is_object(r)
        attributes = _get(r, "$.attributes")
        return F.array(
            _issue(at, "must be an object", ~plain),
            _issue(F.concat(at, F.lit(".type")), "must be a non-empty string", plain & _not_text(_get(r, "$.type"))),
            _issue(F.concat(at, F.lit(".id")), "must be a non-empty string", plain & _not_text(_get(r, "$.id"))),
            _issue(F.concat(at, F.lit(".attributes")), "must be an object", plain & attributes.isNotNull() & ~J.is_object(attributes)),
        )

    wrong = F.array(_issue(name, "must be an array when present", F.lit(True)))
    return F.when(whole.isNull(), F.array().cast(ISSUES)).when(items.isNull(), wrong).otherwise(F.flatten(F.transform(items, of)))


def envelope_issues(doc: Column) -> Column:
    """All structural issues of an object, in the order of the envelope's fields."""
    plain = [_issue(f, "must be a non-empty string", _not_text(_get(doc, f"$.{f}"))) for f in ("eventId", "envelopeVersion", "schemaVersion", "kind", "occurredAt")]
    source = _get(doc, "$.source")
    is_object = J.is_object(source)
    own = [_issue("source", "must be an object when present", source.isNotNull() & ~is_object)]
    for key in ("system", "connector", "version"):
        v = _get(doc, f"$.source.{key}")
        own.append(_issue(f"source.{key}", "must be a string when present", is_object & v.isNotNull() & ~J.is_string(v)))
    fixed = F.array(*plain, _issue("payload", "is required", _get(doc, "$.payload").isNull()))
    found = F.concat(fixed, _ref_issues(doc, "actors"), _ref_issues(doc, "subjects"), F.array(*own))
    return F.filter(found, lambda x: x.isNotNull())


def _single(doc: Column, name: str) -> tuple[Column, Column]:
    """The only ref of an array of one, and whether there is exactly one: the common case, which needs no array functions."""
    first = _get(doc, f"$.{name}[0]")
    return first, first.isNotNull() & _get(doc, f"$.{name}[1]").isNull()


def _ref_fine(doc: Column, name: str) -> Column:
    r, one = _single(doc, name)
    attributes = _get(r, "$.attributes")
    fine = J.is_object(r) & ~_not_text(_get(r, "$.type")) & ~_not_text(_get(r, "$.id")) & (attributes.isNull() | J.is_object(attributes))
    return _get(doc, f"$.{name}").isNull() | (one & fine)


def _envelope_fine(doc: Column) -> Column:
    """Whether an envelope is plainly well-formed, without arrays; where it is not, :func:`envelope_issues` decides."""
    fine = _get(doc, "$.payload").isNotNull()
    for f in ("eventId", "envelopeVersion", "schemaVersion", "kind", "occurredAt"):
        fine = fine & ~_not_text(_get(doc, f"$.{f}"))
    source = _get(doc, "$.source")
    own = J.is_object(source)
    for key in ("system", "connector", "version"):
        v = _get(doc, f"$.source.{key}")
        own = own & (v.isNull() | J.is_string(v))
    return F.coalesce(fine & (source.isNull() | own) & _ref_fine(doc, "actors") & _ref_fine(doc, "subjects"), F.lit(False))


def _refs(doc: Column, name: str, resolver: Callable[[Column], Column]) -> Column:
    items = _get(doc, f"$.{name}", "array<variant>")
    one = lambda r: F.struct(
        _get(r, "$.type", "string").alias("type"), _get(r, "$.id", "string").alias("id"), F.to_json(_get(r, "$.attributes")).alias("attributes")
    )
    kind = f"array<{REF}>"
    first, single = _single(doc, name)
    many = F.coalesce(F.transform(items, lambda r: resolver(one(r))), F.array()).cast(kind)
    return F.when(_get(doc, f"$.{name}").isNull(), F.array().cast(kind)).when(single, F.array(resolver(one(first))).cast(kind)).otherwise(many)


def _bare(doc: Column, name: str) -> Column:
    """Whether the refs surely have no attributes to write canonically."""
    first, single = _single(doc, name)
    return _get(doc, f"$.{name}").isNull() | (single & _get(first, "$.attributes").isNull())


def _with_exact_attributes(refs: str) -> Column:
    bare = F.col(f"{refs}_bare")
    texts = C.exact_all(F.when(~bare, F.transform(F.col(refs), lambda r: r["attributes"])))
    return F.when(bare, F.col(refs)).otherwise(F.zip_with(refs, texts, lambda r, t: F.struct(r["type"].alias("type"), r["id"].alias("id"), t.alias("attributes"))))


@dataclass
class _Program:
    """The columns of the four steps of :func:`verdicts`, which depend on nothing but the options."""

    options: Options
    first: list[Column]
    judged: list[Column]
    verdict: Column
    shaped: list[Column]
    final: list[Column | str]


#: Programs of a session, the last ones used: building one takes thousands of calls to the JVM, too many for every micro-batch.
_PROGRAMS: dict[tuple[str, int], _Program] = {}
_MAX_PROGRAMS = 32


def _program(spark: SparkSession, options: Options) -> _Program:
    key = (spark.sparkContext.applicationId, id(options))
    kept = _PROGRAMS.get(key)
    if kept is None or kept.options is not options:
        while len(_PROGRAMS) >= _MAX_PROGRAMS:
            del _PROGRAMS[next(iter(_PROGRAMS))]
        kept = _PROGRAMS[key] = _compiled(options)
    return kept


def _compiled(options: Options) -> _Program:
    registry, doc = Registry(options.specs), F.col("doc")
    no_issues = F.array().cast(ISSUES)
    not_object = F.array(F.struct(F.lit("").alias("path"), F.lit("must be an object").alias("message"))).cast(ISSUES)
    envelope = F.when(doc.isNull(), not_object).when(_envelope_fine(doc), no_issues).otherwise(envelope_issues(doc))
    fields = (("eventId", "event_id"), ("envelopeVersion", "envelope"), ("schemaVersion", "schema"), ("kind", "kind"), ("occurredAt", "occurred"))
    first = [F.explode(F.array(envelope)).alias("env"), *[J.string_field(doc, f"$.{p}").alias(c) for p, c in fields]]
    kind, version, payload = F.col("kind"), F.col("schema"), F.col("payload")
    well = F.size("env") == 0
    found = registry.pick(kind, version, lambda s, here: s.issues(payload, here & well), F.lit(None).cast(ISSUES))
    judged = [F.when(well, found).alias("found"), F.when(well, parse_ms(F.col("occurred"), options.timestamp_policy)).alias("at")]
    verdict = F.struct(
        F.when(~well, "MALFORMED_ENVELOPE")
        .when(~F.col("envelope").isin(*options.envelope_versions), "UNSUPPORTED_ENVELOPE_VERSION")
        .when(~registry.known_kind(kind), "UNKNOWN_KIND")
        .when(F.col("found").isNull(), "SCHEMA_VERSION_MISMATCH")
        .when(F.size("found") > 0, "INVALID_PAYLOAD")
        .when(F.col("at").isNull(), "INVALID_TIMESTAMP").alias("reason"),
        F.col("found").alias("payload_issues"), F.col("at").alias("when"),
    )
    reason, q = F.col("v.reason"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rfc = F.lit(' must be an RFC 3339 timestamp with a timezone offset (e.g. a trailing "Z")' if options.timestamp_policy == "rfc3339" else " is not a parseable timestamp")
    message = (
        F.when(reason == "MALFORMED_ENVELOPE", F.when(doc.isNull(), "event must be an object").otherwise("event envelope is malformed"))
        .when(reason == "UNSUPPORTED_ENVELOPE_VERSION", F.concat(F.lit("unsupported envelopeVersion "), q(F.col("envelope")), F.lit("; supported: " + ", ".join(options.envelope_versions))))
        .when(reason == "UNKNOWN_KIND", F.concat(F.lit("no validator registered for kind "), q(kind)))
        .when(reason == "SCHEMA_VERSION_MISMATCH", F.concat(F.lit("kind "), q(kind), F.lit(" has no validator for schemaVersion "), q(version), F.lit("; known: "), registry.versions_text(kind)))
        .when(reason == "INVALID_PAYLOAD", F.concat(F.lit("payload failed validation for kind "), q(kind)))
        .when(reason == "INVALID_TIMESTAMP", F.concat(F.lit("occurredAt "), q(F.col("occurred")), rfc))
    )
    valid = reason.isNull()
    status = F.when(valid, "valid").when((reason == "UNKNOWN_KIND") & F.lit(options.unknown_kind == "skip"), "skipped").otherwise("rejected")
    type_ = registry.pick(kind, version, lambda s, _: F.lit(s.type), F.lit(None).cast("string"))
    attributes = registry.pick(kind, version, lambda s, here: s.attributes(payload, here & valid), F.lit(None).cast("string"))
    event_id = F.when(F.col("event_id") != "", F.col("event_id"))
    shaped = [
        F.col("arrival"), status.alias("status"), event_id.alias("event_id"), reason.alias("reason"), message.alias("message"),
        F.when(reason == "MALFORMED_ENVELOPE", F.col("env")).when(reason == "INVALID_PAYLOAD", F.col("v.payload_issues")).otherwise(no_issues).alias("issues"),
        F.when(valid, type_).alias("type"), F.when(valid, F.col("v.when")).alias("at"), F.when(valid, attributes).alias("attributes"),
        F.when(valid, _refs(doc, "actors", options.resolver)).alias("actors"), F.when(valid, _refs(doc, "subjects", options.resolver)).alias("subjects"),
        F.coalesce(_bare(doc, "actors"), F.lit(False)).alias("actors_bare"), F.coalesce(_bare(doc, "subjects"), F.lit(False)).alias("subjects_bare"),
        F.when(valid, F.struct(*[J.string_field(doc, f"$.source.{k}").alias(k) for k in ("system", "connector", "version")])).alias("source"),
        F.when(valid, F.struct(F.col("envelope"), F.col("schema"), F.lit(options.normalization_version).alias("normalization"), J.string_field(doc, "$.source.version").alias("source"))).alias("versions"),
    ]
    oid = F.when(F.col("status") == "valid", C.observation_id(F.col("event_id"), F.col("type"), F.lit(options.normalization_version)))
    final = [
        "arrival", "status", "event_id", "reason", "message", "issues", oid.alias("id"), "type", "at", C.exact(F.col("attributes")).alias("attributes"),
        _with_exact_attributes("actors").alias("actors"), _with_exact_attributes("subjects").alias("subjects"), "source", "versions",
    ]
    return _Program(options, first, judged, verdict, shaped, final)


def verdicts(deliveries: DataFrame, options: Options) -> DataFrame:
    """One row a delivery (arrival, raw): status 'valid', 'rejected' or 'skipped', and either the observation's columns (all
    but ingested_at and integrity, which need the clock) or reason, message and issues.

    A text that is not one JSON object, null texts among them, is a malformed envelope. Row generators hold what is made
    once: the parsed text, the envelope's issues, the verdict.
    """
    J.allow_repeated_keys(deliveries.sparkSession)
    p = _program(deliveries.sparkSession, options)
    raws = spread(deliveries.select("arrival", "raw")).select("arrival", C.settled_text(F.col("raw")).alias("raw"))
    parsed = J.parsed(raws, "raw", "doc").select("arrival", "doc", *p.first).select("*", F.explode(F.array(_get(F.col("doc"), "$.payload"))).alias("payload"))
    judged = parsed.select("*", *p.judged).select("*", F.explode(F.array(p.verdict)).alias("v"))
    out = judged.select(*p.shaped).select(*p.final)
    return out if options.resolver_table is None else resolved_by_table(out, options.resolver_table)


def resolved_by_table(judged: DataFrame, known: DataFrame) -> DataFrame:
    """The verdicts with the refs that ``known`` (ref_type, ref_id, to_type, to_id) lists under their new type and id.

    The distinct refs of the batch meet the table, so a ref that a third of all events name is looked up once; the found
    ones go back to their events, hot ones by broadcast. Of a ref listed twice the smallest target counts; rows of the table
    with nulls count for nothing, and refs that are not listed stay.
    """
    judged = written(judged, "judged")
    listed = known.dropna(subset=["ref_type", "ref_id", "to_type", "to_id"]).groupBy("ref_type", "ref_id").agg(F.min(F.struct("to_type", "to_id")).alias("to"))
    roles = [judged.select("arrival", F.lit(role).alias("role"), F.posexplode(role).alias("pos", "r")) for role in ("actors", "subjects")]
    refs = roles[0].unionByName(roles[1]).select("arrival", "role", "pos", F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id"))
    refs = refs.withColumn("ref", F.concat_ws("\u0000", "ref_type", "ref_id"))
    met = refs.groupBy("ref", "ref_type", "ref_id").agg(F.count("*").alias("n")).join(listed, ["ref_type", "ref_id"]).select("ref", "to", "n")
    met = written(met, "resolved")
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_to_unique(refs.select("arrival", "role", "pos", "ref"), met, "ref", "n", total)
    place = F.concat_ws(":", "role", F.col("pos").cast("string"))
    by_event = found.groupBy("arrival").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("p"), F.col("to")))).alias("__to"))

    def changed(role: str) -> Column:
        def one(r: Column, i: Column) -> Column:
            to = F.try_element_at("__to", F.concat_ws(":", F.lit(role), i.cast("string")))
            return F.struct(F.coalesce(to["to_type"], r["type"]).alias("type"), F.coalesce(to["to_id"], r["id"]).alias("id"), r["attributes"].alias("attributes"))

        return F.when(F.col("__to").isNull(), F.col(role)).otherwise(F.transform(role, one))

    return judged.join(by_event, "arrival", "left").withColumns({r: changed(r) for r in ("actors", "subjects")}).select(*judged.columns)


OBSERVATION = ["id", "type", "at", "ingested_at", "actors", "subjects", "attributes", "source", "source_event_id", "versions", "integrity"]


def observations(valid: DataFrame, ingested_at: Column, secret: str | bytes | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The observation rows of valid verdicts, sealed with their integrity."""
    rows = valid.withColumn("ingested_at", ingested_at.cast("bigint")).withColumn("source_event_id", F.col("event_id"))
    return rows.withColumn("integrity", C.integrity(secret)).select(*keep, *OBSERVATION)


def renormalize(events: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(observations, rejections) of archived events under other options: no storage, no deduplication, no skipping."""
    judged = verdicts(events, options)
    bad = judged.where(F.col("status") != "valid").select("arrival", "event_id", "reason", "message", "issues")
    return observations(judged.where(F.col("status") == "valid"), F.lit(options.clock.at().start), options.integrity_secret, ("arrival",)), bad
