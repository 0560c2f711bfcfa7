"""The audit trail: what each delivery leaves in it, the hash chain, its verification and its export."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import canonical as C
from strandloom.operators.normalize import UNKNOWN_EVENT, Clock
from strandloom.operators.ordering import before_parts, parts_for, with_running_sums
from strandloom.session import discard, passing, scratch, written

GENESIS = "genesis"
AUDIT = "id string, stage string, outcome string, event_id string, observation_id string, at bigint, detail string, sequence bigint, previous_hash string, hash string"


def _record(stage: str, outcome: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(outcome).alias("outcome"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


#: Audit records of a delivery by its status.
RECORDS = {"accepted": 5, "duplicate": 2, "rejected": 2, "skipped": 1}


def records_per() -> Column:
    return F.coalesce(*[F.when(F.col("status") == s, n) for s, n in RECORDS.items()])


def clock_reads(archived: bool = False) -> Column:
    """How often a delivery reads the clock: for the archive if there is one, for ingested_at if it is valid, once per record."""
    own = F.when(F.col("status").isin("accepted", "duplicate"), 1).otherwise(0)
    return records_per() + own + int(archived)


def records_of(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """arrival, k (place within the delivery), stage, outcome, event_id, observation_id, detail of every result, and its columns ``keep``."""
    q = C.quoted
    issue = lambda x: C.obj(path=q(x["path"]), message=q(x["message"]))
    issues = F.when(F.size("issues") > 0, F.concat(F.lit("["), F.array_join(F.transform("issues", issue), ","), F.lit("]")))
    reason, message = q(F.col("reason")), q(F.col("message"))
    counts = C.obj(actors=F.size("actors").cast("string"), subjects=F.size("subjects").cast("string"))
    passed = _record("validation", "passed")
    chosen = (
        F.when(F.col("status") == "accepted", F.array(passed, _record("normalization", "passed"), _record("attribution", "passed", counts), _record("dedupe", "unique"), _record("storage", "stored")))
        .when(F.col("status") == "duplicate", F.array(passed, _record("dedupe", "duplicate")))
        .when(F.col("status") == "rejected", F.array(_record("validation", "failed", C.obj(reason=reason)), _record("rejection", "rejected", C.obj(reason=reason, message=message, issues=issues))))
        .otherwise(F.array(_record("validation", "skipped", C.obj(reason=reason, message=message))))
    )
    linked = F.when(F.col("status").isin("accepted", "duplicate"), F.col("id"))
    rows = results.select("arrival", F.coalesce("event_id", F.lit(UNKNOWN_EVENT)).alias("event_id"), linked.alias("observation_id"), *keep, F.posexplode(chosen).alias("k", "r"))
    return rows.select("arrival", "k", *keep, F.col("r.stage").alias("stage"), F.col("r.outcome").alias("outcome"), "event_id", "observation_id", F.col("r.detail").alias("detail"))


def sequenced(results: DataFrame, clock: Clock, first_sequence: int = 0, archived: bool = False) -> DataFrame:
    """The records with sequence, at and a deterministic id. ``results`` carries ``reads_before`` and ``records_before``, the
    clock reads and the records of all earlier deliveries."""
    own = F.when(F.col("status").isin("accepted", "duplicate"), 1).otherwise(0) + int(archived)
    placed = results.withColumn("first_read", F.col("reads_before") + own)
    sequence = F.col("records_before") + F.col("k") + first_sequence
    at = F.lit(clock.start).cast("bigint") + (F.col("first_read") + F.col("k")) * clock.step
    rows = records_of(placed, ("records_before", "first_read"))
    return rows.select(F.concat(F.lit("rec-"), sequence.cast("string")).alias("id"), "stage", "outcome", "event_id", "observation_id", at.alias("at"), "detail", sequence.alias("sequence"))


def record_json(previous: Column) -> Column:
    c, q = F.col, C.quoted
    return C.obj(
        id=q(c("id")), stage=q(c("stage")), outcome=q(c("outcome")), eventId=q(c("event_id")), at=c("at").cast("string"), sequence=c("sequence").cast("string"),
        previousHash=q(previous), observationId=q(c("observation_id")), detail=c("detail"),
    )


#: Stands for the hash not known yet. Inside any string of a record its quotes would be escaped, so it is found nowhere else.
_HOLE = '"previousHash":"@@previous@@"'
#: Records whose texts one task of the fold reads at a time, about, and folders of such texts at most.
FOLD_ROWS, MAX_FOLDERS = 1_000_000, 20_000
_HASHES = "sequence bigint, previous_hash string, hash string"


def _fold(previous: str, secret: str | bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = secret.encode() if isinstance(secret, str) else secret

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = previous
        for batch in batches:
            before, hashes = [], []
            for text in batch.column(1).to_pylist():
                before.append(last)
                data = text.replace(_HOLE, f'"previousHash":"{last}"', 1).encode()
                last = (hashlib.sha256(data) if key is None else hmac.new(key, data, hashlib.sha256)).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.string()), pa.array(hashes, pa.string())], ["sequence", "previous_hash", "hash"])

    return run


def chained(records: DataFrame, previous: str = GENESIS, secret: str | bytes | None = None, first: int | None = None, count: int | None = None, out: str | None = None) -> DataFrame:
    """The records with previous_hash and hash, stored in the order of the sequence. first, count: the smallest sequence and
    how many there are, if known. out: the folder to store them in, else one of the shared folder.

    Only the fold cannot be split. The records are stored by ranges of the sequence. Of one range after the other texts are
    made in parallel, one small task reads its sequences and texts, nothing else, carrying the last hash over, and the
    range is stored with its hashes in parallel before the next one begins: beside the records and the trail, only one
    range's hashes are ever on disk.
    """
    if first is None or count is None:
        low, high = records.agg(F.min("sequence"), F.max("sequence")).first()
        first, count = (low or 0), 0 if low is None else high - low + 1
    spark, columns = records.sparkSession, [c.split()[0] for c in AUDIT.split(", ")]
    path, out = scratch(spark, "records"), out or scratch(spark, "trail")
    if not count:
        records.withColumns({c: F.lit(None).cast("string") for c in ("previous_hash", "hash")}).select(*columns).write.parquet(out)
        return spark.read.schema(AUDIT).parquet(out)
    width = max(FOLD_ROWS // 20, -(-count // MAX_FOLDERS))
    parts = -(-count // width)
    at = F.floor((F.col("sequence") - first) / width).cast("int")
    placed = records.withColumn("__part", at)
    last, step = previous, max(1, FOLD_ROWS // width)
    try:
        with passing(spark):
            in_order = placed.repartition(parts, "__part").sortWithinPartitions("__part", "sequence")
            in_order.write.partitionBy("__part").option("compression", "zstd").parquet(path)
            ready = spark.read.schema(placed.schema).parquet(path)
            for low in range(0, parts, step):
                some = ready.where((F.col("__part") >= low) & (F.col("__part") < low + step))
                texts = some.select("sequence", record_json(F.lit("@@previous@@")).alias("__text"))
                with passing(spark):
                    hashes = written(texts.repartition(1).sortWithinPartitions("sequence").mapInArrow(_fold(last, secret), _HASHES), "hashes")
                    sealed = some.drop("__part").join(hashes, "sequence").select(*columns)
                    in_order = sealed.repartitionByRange(min(step, spark.sparkContext.defaultParallelism), "sequence").sortWithinPartitions("sequence")
                    in_order.write.mode("append").option("compression", "zstd").parquet(out)
                    if low + step < parts:
                        last = hashes.agg(F.max_by("hash", "sequence")).first()[0] or last
    finally:
        discard(spark, path)
    return spark.read.schema(AUDIT).parquet(out)


#: Stretches of records whose places follow one another: the first and last place, how many, the first record's own values,
#: the first later record that cannot be right whatever comes before, and the last hash.
_STRETCHES = "first bigint, last bigint, n bigint, sequence bigint, previous_hash string, good boolean, bad bigint, reason string, hash string"
_REASONS = (None, "bad_sequence", "broken_link", "bad_hash")


def _stretched(single: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch (place, sequence, previous_hash, hash, good) in the order it is read, its stretches; single: one a record."""

    def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (rows := batch.num_rows):
                continue
            (at, there), (sequence, has), good = numbers(batch.column(0)), numbers(batch.column(1)), batch.column(4).to_numpy(zero_copy_only=False)
            before, own = batch.column(2), batch.column(3)
            begins = np.ones(rows, bool)
            if not single:
                begins[1:] = ~(there[1:] & there[:-1] & (at[1:] - 1 == at[:-1]))
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], rows)
            stretch = np.cumsum(begins) - 1
            inner = np.arange(rows) - starts[stretch]
            linked = np.ones(rows, bool)
            link, nulls = pc.equal(before[1:], own[:-1]).fill_null(False), pc.and_(before[1:].is_null(), own[:-1].is_null())
            linked[1:] = pc.or_(link, nulls).to_numpy(zero_copy_only=False)
            in_line = has & has[starts][stretch] & (sequence - inner == sequence[starts][stretch])
            wrong = np.where(begins, 0, np.where(~in_line, 1, np.where(~linked, 2, np.where(~good, 3, 0))))
            found = np.flatnonzero(wrong)
            of, which = np.unique(stretch[found], return_index=True)
            bad, reason = [None] * len(starts), [None] * len(starts)
            for s, row in zip(of.tolist(), found[which].tolist(), strict=True):
                bad[s], reason[s] = row - int(starts[s]), _REASONS[wrong[row]]
            lead, tail = pa.array(starts), pa.array(ends - 1)
            take = [batch.column(0).take(lead), batch.column(0).take(tail), pa.array(ends - starts), batch.column(1).take(lead), before.take(lead), batch.column(4).take(lead)]
            yield pa.RecordBatch.from_arrays([*take, pa.array(bad, pa.int64()), pa.array(reason, pa.string()), own.take(tail)], [c.split()[0] for c in _STRETCHES.split(", ")])

    return run


def _judged(checked: DataFrame, single: bool) -> tuple[int, int | None, str | None, bool]:
    """length, broken_at, reason of checked records, and whether stretches lie across each other, so that these don't hold."""
    stretches = written(checked.mapInArrow(_stretched(single), _STRETCHES), "stretches")
    ranged = written(stretches.repartitionByRange(parts_for(checked.sparkSession, stretches.count()), "first").withColumn("__part", F.spark_partition_id()), "ranged")
    inner = Window.partitionBy("__part").orderBy("first")
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    linked = ranged.withColumns({"__before": F.lag("hash").over(inner), "__row": F.row_number().over(inner) - 1, "__n": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "__reached": F.max("last").over(earlier)})
    totals = ranged.groupBy("__part").agg(F.sum("n").alias("n"), F.max_by("hash", "first").alias("hash"), F.max("last").alias("last"))
    parts = Window.orderBy("__part")
    ends = totals.select("__part", F.lag("hash").over(parts).alias("__last"), F.max("last").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    bounds = before_parts(totals, offset="n").join(F.broadcast(ends), "__part")
    placed = linked.join(F.broadcast(bounds), "__part").withColumn("pos", F.col("__n") + F.col("offset"))
    before = F.when(F.col("pos") == 0, GENESIS).when(F.col("__row") == 0, F.col("__last")).otherwise(F.col("__before"))
    lead = (
        F.when(~F.col("sequence").eqNullSafe(F.col("pos")), "bad_sequence")
        .when(~F.col("previous_hash").eqNullSafe(before), "broken_link")
        .when(~F.col("good"), "bad_hash")
    )
    across = F.coalesce(F.greatest("__reached", "__far") >= F.col("first"), F.lit(False))
    found = placed.select("n", across.alias("across"), F.coalesce(lead, "reason").alias("wrong"), F.when(lead.isNotNull(), F.col("pos")).otherwise(F.col("pos") + F.col("bad")).alias("at"))
    out = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("at"), F.min_by("wrong", "at"), F.coalesce(F.bool_or("across"), F.lit(False)))
    return tuple(out.first())


def verify_chain(trail: DataFrame, secret: str | bytes | None = None, position: str = "sequence") -> DataFrame:
    """One row: ok, length, broken_at, reason (bad_sequence, broken_link or bad_hash) of a trail in the order of ``position``.

    The place in the list must equal the sequence. Hashes are made anew and records meet the one before them where the rows
    lie; each stretch of records whose places follow one another becomes one row, and only these are range-partitioned, meet
    the one before inside their range, and the first of a range the last of the range before (at most MAX_PARTS rows). A
    stored trail has few stretches; one in no order has as many as records. Where stretches lie across each other, as with a
    place that is there twice, each record is one. The first failing place decides.
    """
    spark = trail.sparkSession
    made = C.digest(record_json(F.col("previous_hash")), secret)
    whole = dict(trail.dtypes)[position] in ("tinyint", "smallint", "int", "bigint")
    at = F.col(position).cast("bigint") if whole else F.col(position)
    checked = trail.select(at.alias("__at"), F.col("sequence").cast("bigint").alias("sequence"), "previous_hash", "hash", F.col("hash").eqNullSafe(made).alias("good"))
    with passing(spark):
        if not whole:
            checked = with_running_sums(checked, "__at", {"__place": 1}).select(F.col("__place").alias("__at"), *checked.columns[1:])
        length, broken_at, reason, across = _judged(checked, False)
        if across:
            length, broken_at, reason, _ = _judged(checked, True)
    ok = broken_at is None
    return spark.createDataFrame([(ok, length if ok else None, broken_at, reason)], "ok boolean, length bigint, broken_at bigint, reason string")


def ndjson(trail: DataFrame) -> DataFrame:
    """sequence and line: each record as one JSON object, members in the order they are made in."""
    c, q = F.col, C.quoted
    members = [("id", q(c("id"))), ("stage", q(c("stage"))), ("outcome", q(c("outcome"))), ("eventId", q(c("event_id"))), ("at", c("at").cast("string")),
               ("sequence", c("sequence").cast("string")), ("previousHash", q(c("previous_hash"))), ("observationId", q(c("observation_id"))), ("detail", c("detail")), ("hash", q(c("hash")))]
    line = F.concat(F.lit("{"), F.concat_ws(",", *[C.member(k, v) for k, v in members]), F.lit("}"))
    return trail.select("sequence", line.alias("line"))


def tail(trail: DataFrame) -> DataFrame:
    """The record of the largest sequence: no row for an empty trail."""
    return trail.orderBy(F.desc("sequence")).limit(1)
