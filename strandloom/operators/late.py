"""Problem 6: hourly counts by event time that late rows correct until a cut-off.

Each batch appends its rows to the retained raw events, names the partitions it touches, and recomputes those entirely from
what is retained; a new version of a partition replaces the old one by one commit of the manifest, so readers see either.
Rows later than the cut-off are set aside and change nothing. A period is an hour; its partition is the run of ``days`` UTC
days it lies in.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.instants import observed_ms
from strandloom.session import scratch, shared_files

HOUR = 3_600_000
DAY = 24 * HOUR
#: Retained rows of one batch and partition that one task writes, about.
TASK_ROWS = 2_000_000
#: Batches after which the retained rows of their partitions are written together.
COMPACT_AT = 16
#: Partitions one batch may touch and still name them one by one; a batch that touches more recomputes all there are.
MAX_NAMED = 10_000

RETAINED = "insert_seq bigint, hour_start bigint, verdict string, batch int, part bigint"
HOURS = "hour_start bigint, on_time bigint, corrections bigint, total bigint, last_batch int, part bigint"


def verdict(event_ms: Column, ingested_ms: Column, cutoff_ms: int) -> Column:
    """on_time, correction or too_late; NULL without both times. The cut-off itself is still a correction."""
    end = (F.floor(event_ms / HOUR) + 1) * HOUR
    return F.when(ingested_ms < end, "on_time").when(ingested_ms <= end + cutoff_ms, "correction").when(ingested_ms.isNotNull() & event_ms.isNotNull(), "too_late")


class LateHours:
    """The state below one shared folder: retained raw events, versions of hour partitions, and the manifest of the current ones.

    A folder opened again goes on where its last manifest stands. Batches have numbers; one that was committed is not taken
    in again, and what a failed one wrote is written over when it is repeated.
    """

    def __init__(self, spark: SparkSession, root: str, cutoff_hours: int = 48, days: int = 1):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = shared_files(spark, self.root)
        self.state = {"version": 0, "cutoff_ms": cutoff_hours * HOUR, "span": days * DAY, "last": 0, "done": [], "retained": [], "current": {}}
        names = [n for n in self._files.names("manifest") if n.endswith(".json")]
        if names:
            self.state = json.loads(self._files.read(f"manifest/{names[-1]}"))

    def is_done(self, number: int) -> bool:
        return number <= self.state["last"] or number in self.state["done"]

    def ingest(self, rows: DataFrame, number: int | None = None) -> None:
        """Take in insert_seq, event_ms, ingested_at of one batch (``number`` from 0, else the next one)."""
        number = (max([self.state["last"], *self.state["done"]]) if self.state["version"] else -1) + 1 if number is None else number
        if self.state["version"] and self.is_done(number):
            return
        span = self.state["span"]
        hour = F.floor(F.col("event_ms") / HOUR) * HOUR
        judged = rows.select("insert_seq", hour.alias("hour_start"), verdict(F.col("event_ms"), F.col("ingested_at"), self.state["cutoff_ms"]).alias("verdict"))
        judged = judged.where(F.col("verdict").isNotNull()).withColumns({"batch": F.lit(number), "part": F.floor(F.col("hour_start") / span), "late": F.col("verdict") == "too_late"})
        path = f"retained/0-batch-{number:09d}"
        salt = max(1, rows.count() // TASK_ROWS)
        judged.repartition("late", "part", F.pmod("insert_seq", F.lit(salt))).write.mode("overwrite").partitionBy("late", "part").parquet(f"{self.root}/{path}")
        retained = [*self.state["retained"], path]
        kept = self.retained([path])
        parts = [r["part"] for r in kept.select("part").distinct().limit(MAX_NAMED + 1).collect()]
        version = self.state["version"] + 1
        current = dict(self.state["current"])
        if parts:
            touched = self.retained(retained)
            if len(parts) <= MAX_NAMED:
                touched = touched.where(F.col("part").isin(parts))
            hours = f"hours/v-{version:09d}"
            self._recompute(touched).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{hours}")
            named = parts if len(parts) <= MAX_NAMED else [int(n.removeprefix("part=")) for n in self._files.names(hours) if n.startswith("part=")]
            current |= {str(p): hours for p in named}
        self._commit(number, version, self._compacted(retained, version), current)

    def _compacted(self, paths: list[str], version: int, level: int = 0) -> list[str]:
        """COMPACT_AT folders of one level become one of the next, so a row is written again once a level.

        The old folders stay on disk for whoever still reads them.
        """
        own = [p for p in paths if p.startswith(f"retained/{level}-")]
        if len(own) < COMPACT_AT:
            return paths
        out = f"retained/{level + 1}-to-{version:09d}"
        some = self._rows(own)
        some.repartition("late", "part", F.pmod("insert_seq", F.lit(max(1, some.count() // TASK_ROWS)))).write.mode("overwrite").partitionBy("late", "part").parquet(f"{self.root}/{out}")
        return self._compacted([*[p for p in paths if p not in own], out], version, level + 1)

    def _rows(self, paths: list[str]) -> DataFrame:
        schema = RETAINED.replace(", part bigint", ", late boolean, part bigint")
        out = self.spark.createDataFrame([], schema)
        for p in paths:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{p}"))
        return out

    def retained(self, paths: list[str] | None = None) -> DataFrame:
        """insert_seq, hour_start, verdict, batch, part of the rows that count."""
        return self._rows(self.state["retained"] if paths is None else paths).where(~F.col("late")).drop("late")

    def verdicts(self) -> DataFrame:
        """insert_seq, verdict of all rows taken in that have both times: the retained ones and those set aside as too late."""
        return self._rows(self.state["retained"]).select("insert_seq", "verdict")

    @staticmethod
    def _recompute(rows: DataFrame) -> DataFrame:
        late = F.col("verdict") == "correction"
        return rows.groupBy("part", "hour_start").agg(
            F.count_if(~late).alias("on_time"), F.count_if(late).alias("corrections"), F.count("*").alias("total"), F.max("batch").alias("last_batch")
        )

    def _commit(self, number: int, version: int, retained: list[str], current: dict[str, str]) -> None:
        """One small file a commit, renamed into place; the newest is the truth. Numbers up to ``last`` are all done."""
        done, last = {*self.state["done"], number}, self.state["last"] if self.state["version"] else -1
        while last + 1 in done:
            last += 1
            done.remove(last)
        state = self.state | {"version": version, "last": last, "done": sorted(done), "retained": retained, "current": current}
        if not self._files.write(f"manifest/{version:09d}.json", json.dumps(state), replace=False):
            raise RuntimeError("another writer committed this version")
        self.state = state

    def hours(self) -> DataFrame:
        """hour_start, on_time, corrections, total, last_batch of every hour that has counted rows."""
        by_version: dict[str, list[int]] = {}
        for part, path in self.state["current"].items():
            by_version.setdefault(path, []).append(int(part))
        out = self.spark.createDataFrame([], HOURS)
        for path, parts in sorted(by_version.items()):
            out = out.unionByName(self.spark.read.schema(HOURS).parquet(f"{self.root}/{path}").where(F.col("part").isin(parts)))
        return out.drop("part")


def replay(observations: DataFrame, batches: int = 4, cutoff_hours: int = 48, days: int = 16) -> LateHours:
    """All observations taken in by ingested_at in ``batches``.

    The rows are split by batch in one pass, so each batch reads its own part only. A batch here spans months, so partitions
    of 16 days fit it; batches of a day fit partitions of a day. NULL observed_at or ingested_at give no verdict and are not
    counted; repeated rows all count.
    """
    spark = observations.sparkSession
    rows = observations.select("insert_seq", observed_ms("observed_at").alias("event_ms"), F.col("ingested_at").cast("bigint").alias("ingested_at"))
    lo, hi = rows.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    lo, span = (lo or 0), max(1, (hi or 0) - (lo or 0) + 1)
    number = F.least(F.floor((F.col("ingested_at") - lo) * batches / F.lit(span)).cast("int"), F.lit(batches - 1))
    path = scratch(spark, "by-batch")
    rows.where(F.col("event_ms").isNotNull() & F.col("ingested_at").isNotNull()).withColumn("number", number).write.partitionBy("number").parquet(path)
    split = spark.read.schema("insert_seq bigint, event_ms bigint, ingested_at bigint, number int").parquet(path)
    state = LateHours(spark, scratch(spark, "late"), cutoff_hours, days)
    for b in range(batches):
        state.ingest(split.where(F.col("number") == b), b)
    return state


def late_rows(observations: DataFrame, batches: int = 4) -> DataFrame:
    """insert_seq, verdict of the rows that corrected an hour or came too late for it, as the state holds them."""
    return replay(observations, batches).verdicts().where(F.col("verdict") != "on_time")


def corrected_hours(observations: DataFrame, batches: int = 4) -> DataFrame:
    return replay(observations, batches).hours().drop("last_batch")
