"""Contiguous ranks and running sums over a global order without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.session import written

#: Parts of the range partitioning at most: as many partial sums are broadcast.
MAX_PARTS = 20_000
#: Rows of a part, about, until there are MAX_PARTS; fewer where that would leave cores idle, down to LEAST_ROWS.
PART_ROWS, LEAST_ROWS = 500_000, 5_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Into how many parts to split ``rows``: by their number, but so that all cores have work."""
    busy = min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))
    return max(1, min(MAX_PARTS, max(busy, -(-rows // PART_ROWS))))


def before_parts(totals: DataFrame, **sums: str) -> DataFrame:
    """__part and, for each name, the sum of its column over all smaller parts. ``totals`` has one row a part (MAX_PARTS at most)."""
    up_to = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("__part", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(out) for out, c in sums.items()]))


def with_running_sums(df: DataFrame, order: str, sums: dict[str, Column | int], rows: int | None = None) -> DataFrame:
    """``df`` with a BIGINT column for each of ``sums``: the sum of its value over all rows before in ``order``, from zero.

    Rows are range-partitioned and written; sums run within the parts, and the parts' totals (at most MAX_PARTS rows) are
    added. Ties in ``order`` get distinct, consecutive places. ``df`` should be narrow: it is moved twice. rows: how many it
    has, if that is known.
    """
    values = {f"__v{i}": v if isinstance(v, Column) else F.lit(v) for i, v in enumerate(sums.values())}
    plain = df.columns
    parts = parts_for(df.sparkSession, df.count() if rows is None else rows)
    ranged = written(df.select("*", *[v.cast("bigint").alias(n) for n, v in values.items()]).repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ordered")
    inner = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = before_parts(ranged.groupBy("__part").agg(*[F.sum(n).alias(n) for n in values]), **{f"__b{n}": n for n in values})
    own = ranged.withColumns({f"__o{n}": F.coalesce(F.sum(n).over(inner), F.lit(0)) for n in values})
    return own.join(before, "__part").select(*plain, *[(F.col(f"__o{n}") + F.col(f"__b{n}")).alias(out) for n, out in zip(values, sums, strict=True)])


def with_running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """One running sum, that of the column ``value``."""
    return with_running_sums(df, order, {out: F.col(value)})


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer parts, as from one small file; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
