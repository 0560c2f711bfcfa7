"""Problem 3: one row per actor with count, recency and total for each registered event type.

Rows are first aggregated to a compact long table by actor and type, then pivoted with the explicit list of types, so the
wide step sees one row per actor and type however many events there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.instants import observed_ms
from strandloom.operators.times import small_side

#: More types than this cannot be columns of one table.
MAX_TYPES = 2_000


def first_stored(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per observation id: its first stored row (smallest insert_seq). Rows without an id count each as one.

    Columns obs_type, latest (epoch ms), measure (double or NULL), actors. The first row decides, so an id whose first row has
    a type that is not registered counts for nothing. Measures are read, and what unregistered rows hold is dropped, before
    the shuffle.
    """
    kinds = registry.where(F.col("obs_type").isNotNull()).groupBy("obs_type").agg(F.min("measure_field").alias("__field"))
    known = observations.select("id", "obs_type", "observed_at", "actors", "attributes", "insert_seq").join(small_side(kinds.withColumn("__known", F.lit(True)), MAX_TYPES), "obs_type", "left")
    measure = F.when(F.col("__field").isNotNull(), F.call_function("get_json_object", F.col("attributes"), F.concat(F.lit("$."), F.col("__field"))).try_cast("double"))
    who = F.array_distinct(
        F.transform(
            F.filter("actors", lambda a: a["ref_type"].isNotNull() & a["ref_id"].isNotNull()),
            lambda a: F.struct(a["ref_type"].alias("ref_type"), a["ref_id"].alias("ref_id")),
        )
    )
    row = F.when(F.col("__known"), F.struct("obs_type", observed_ms("observed_at").alias("latest"), measure.alias("measure"), who.alias("actors")))
    key = F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("s"), F.col("insert_seq").cast("string")))
    return known.select(key.alias("__key"), row.alias("__row"), "insert_seq").groupBy("__key").agg(F.min_by("__row", "insert_seq").alias("__row")).where(F.col("__row").isNotNull()).select("__row.*")


def long_features(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """ref_type, ref_id, obs_type, n, latest, total: only pairs that occur. total is NULL if no row has a measure.

    Each observation counts once and each actor once per observation; actors without type or id are none, and types that
    are not registered are left out.
    """
    rows = first_stored(observations, registry).select(F.explode("actors").alias("a"), "obs_type", "latest", "measure")
    return rows.groupBy(F.col("a.ref_type").alias("ref_type"), F.col("a.ref_id").alias("ref_id"), "obs_type").agg(
        F.count("*").alias("n"), F.max("latest").alias("latest"), F.sum("measure").alias("total")
    )


def wide_features(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """ref_type, ref_id and, for every registered type T, T_count (0 if none), T_latest and T_total."""
    kinds = registry.where(F.col("obs_type").isNotNull()).select("obs_type").distinct().limit(MAX_TYPES + 1).collect()
    if len(kinds) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    types = sorted(r["obs_type"] for r in kinds)
    long = long_features(observations, registry)
    wide = long.groupBy("ref_type", "ref_id").pivot("obs_type", types).agg(F.max("n").alias("count"), F.max("latest").alias("latest"), F.max("total").alias("total"))
    q = lambda name: F.col(f"`{name}`")
    columns = [x for t in types for x in (F.coalesce(q(f"{t}_count"), F.lit(0)).alias(f"{t}_count"), q(f"{t}_latest"), q(f"{t}_total"))]
    return wide.select("ref_type", "ref_id", *columns)
