"""The intake engine: deliveries in, canonical observations and an audit trail out."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import audit
from strandloom.operators.normalize import OBSERVATION, Clock, Options, observations, verdicts
from strandloom.operators.ordering import parts_for, with_running_sums
from strandloom.operators.payloads import Registry
from strandloom.operators.skew import join_to_unique
from strandloom.session import passing, scratch, written
from strandloom.sources.stores import ReadApi, Stores


#: Finds among distinct ids (a frame of id) those that are stored already.
Known = Callable[[DataFrame], DataFrame]


def decided(judged: DataFrame, known: Known | None = None) -> DataFrame:
    """arrival, status, winner, stored of verdicts: of each id the smallest arrival is accepted, unless the id is stored already.

    Only arrivals and ids are moved. The first arrival of an id comes from an aggregation with map-side combine; ids with
    very many deliveries are joined back by broadcast, so a hot id does not end up in one task.
    """
    valid = judged.where(F.col("status") == "valid").select("arrival", "id")
    firsts = written(valid.groupBy("id").agg(F.min("arrival").alias("winner"), F.count("*").alias("n")), "firsts")
    if known is not None:
        firsts = firsts.join(known(firsts.select("id")).withColumn("stored", F.lit(True)), "id", "left")
    else:
        firsts = firsts.withColumn("stored", F.lit(None).cast("boolean"))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_to_unique(valid, firsts, "id", "n", total)
    new = (F.col("arrival") == F.col("winner")) & F.col("stored").isNull()
    status = F.when(new, "accepted").otherwise("duplicate")
    rest = judged.where(F.col("status") != "valid")
    return joined.select("arrival", status.alias("status"), "winner", "stored").unionByName(
        rest.select("arrival", "status", F.lit(None).cast("bigint").alias("winner"), F.lit(None).cast("boolean").alias("stored"))
    )


class Batch:
    """What one batch came to. results: a row a delivery; duplicates point to the delivery or stored row they repeat.

    accepted and trail are made when they are first asked for. reads, records: how often the batch read the clock, and its
    audit records.
    """

    def __init__(self, results: DataFrame, clock: Clock, reads: int, records: int, accepted: Callable[[], DataFrame], trail: Callable[..., DataFrame]):
        self.results, self.clock, self.reads, self.records, self._accepted, self._trail = results, clock, reads, records, accepted, trail

    @cached_property
    def accepted(self) -> DataFrame:
        return self._accepted()

    @cached_property
    def trail(self) -> DataFrame:
        return self._trail()

    def trail_at(self, path: str) -> DataFrame:
        """The trail, stored in the folder ``path`` and nowhere else."""
        return self._trail(path)

    def kept(self) -> Batch:
        """The same with accepted written to the shared folder, as the trail is anyway, for more than one reader."""
        return Batch(self.results, self.clock, self.reads, self.records, lambda: written(self.accepted, "accepted", lasting=True), lambda path=None: self.trail if path is None else self.trail_at(path))


def process(
    deliveries: DataFrame, options: Options, *, known: Known | None = None, first_insert: int = 0, first_sequence: int = 0,
    previous: str = audit.GENESIS, clock: Clock | None = None, archived: bool = False,
) -> Batch:
    """Run one batch without storing it. ``deliveries`` has arrival (distinct, the order of delivery) and raw.

    Verdicts are written once as whole rows. Which is accepted, and what comes before each delivery (clock reads, records,
    accepted ones), is worked out on arrivals and ids alone and joined to them once. archived: an archive reads the clock first.
    """
    clock = clock or options.clock.at()
    sums = {"reads_before": audit.clock_reads(archived), "records_before": audit.records_per(), "place": (F.col("status") == "accepted").cast("int")}
    with passing(deliveries.sparkSession):
        judged = written(verdicts(deliveries, options), "verdicts")
        n = judged.count()
        parts = parts_for(judged.sparkSession, n)
        placed = with_running_sums(decided(judged, known), "arrival", sums, n).repartition(parts, "arrival")
        results = written(judged.drop("status").repartition(parts, "arrival").join(placed, "arrival"), "results", lasting=True)
    counts = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}
    records = sum(audit.RECORDS[s] * n for s, n in counts.items())
    reads = records + sum(counts.get(s, 0) for s in ("accepted", "duplicate")) + archived * sum(counts.values())

    def accepted() -> DataFrame:
        at = F.lit(clock.start).cast("bigint") + (F.col("reads_before") + int(archived)) * clock.step
        kept = observations(results.where(F.col("status") == "accepted"), at, options.integrity_secret, ("arrival", "place"))
        return kept.select("arrival", *OBSERVATION, (F.col("place") + first_insert).alias("insert_seq"))

    def trail(path: str | None = None) -> DataFrame:
        return audit.chained(audit.sequenced(results, clock, first_sequence, archived), previous, options.audit_secret, first_sequence, records, path)

    return Batch(results, clock, reads, records, accepted, trail)


class Intake:
    """The engine over stores: durable ones below ``root``, or any that keep the port. One writer; batches come one after the other."""

    def __init__(self, spark: SparkSession, options: Options | None = None, root: str | None = None, keep_raw: bool = False, stores: Stores | None = None):
        self.spark, self.options, self.keep_raw = spark, options or Options(), keep_raw
        if self.options.unknown_kind not in ("reject", "skip"):
            raise ValueError("unknown_kind must be reject or skip")
        self.stores = stores or Stores(spark, root or scratch(spark, "intake"))
        self.read = ReadApi(self.stores, Registry(self.options.specs).observation_types())

    def ingest(self, deliveries: DataFrame, batch: str | None = None) -> DataFrame:
        """Take in (arrival, raw); returns the results. A named batch that was committed before does nothing again.

        Archive, observations, their ids and the audit records are all written first and come into force with the batch's
        name in one commit, so a batch that fails anywhere leaves nothing behind and can be repeated.
        """
        if batch is not None and self.stores.is_done(batch):
            return self.spark.createDataFrame([], "arrival bigint, status string, id string, type string, reason string, message string, event_id string")
        state = self.stores.state
        tail, clock = state["audit_tail"], self.options.clock.at(state["clock_reads"])
        out = process(
            deliveries, self.options, known=self.stores.known_among, first_insert=state["insert_seq"], first_sequence=0 if tail is None else tail["sequence"] + 1,
            previous=audit.GENESIS if tail is None else tail["hash"], clock=clock, archived=self.keep_raw,
        )
        changes = self.stores.archived(self._timed(deliveries, out)) if self.keep_raw else {}
        changes |= self.stores.observations_put(out.accepted.drop("arrival"), checked=True)
        part = self.stores.new_part("audit")
        changes |= self.stores.audit_appended(out.trail if part is None else out.trail_at(f"{self.stores.root}/{part}"), part)
        self.stores.commit(batch, **changes, clock_reads=state["clock_reads"] + out.reads)
        return out.results

    def _timed(self, deliveries: DataFrame, out: Batch) -> DataFrame:
        """The deliveries with received_at, the clock as read just before each was looked at."""
        if not out.clock.step:
            return deliveries.select("arrival", "raw", F.lit(out.clock.start).cast("bigint").alias("received_at"))
        at = F.lit(out.clock.start).cast("bigint") + F.col("reads_before") * out.clock.step
        return deliveries.select("arrival", "raw").join(out.results.select("arrival", at.alias("received_at")), "arrival")

    def observations_of(self, results: DataFrame) -> DataFrame:
        """arrival, status and the stored observation of accepted and duplicate results: duplicates get the original."""
        some = results.where(F.col("status").isin("accepted", "duplicate")).select("arrival", "status", "id")
        return some.join(self.stores.table("observations"), "id")


def evidence(observed: DataFrame) -> DataFrame:
    """id, kind, subject, actor (the first, if any), content, provenance of observations as evidence records."""
    narrow = lambda r: F.struct(r["type"].alias("type"), r["id"].alias("id"))
    actor = F.try_element_at("actors", F.lit(1))
    at = F.date_format(F.to_utc_timestamp(F.timestamp_millis("at"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return observed.select(
        "id", F.concat(F.lit("observation:"), "type").alias("kind"), F.transform("subjects", narrow).alias("subject"), F.when(actor.isNotNull(), narrow(actor)).alias("actor"),
        F.col("attributes").alias("content"), F.struct(F.coalesce("source.system", F.lit("unknown")).alias("source"), at.alias("at")).alias("provenance"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    """status, n of all four statuses, zero included."""
    all_ = results.sparkSession.createDataFrame([(s,) for s in ("accepted", "duplicate", "rejected", "skipped")], "status string")
    return all_.join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0, ["n"])
