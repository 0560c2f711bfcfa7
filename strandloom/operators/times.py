"""Problem 1: every record's time as one UTC instant, or as unresolvable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import jsontext as J
from strandloom.functions.instants import EpochRange, instant, is_canonical, observed_ms

#: source_systems is a fixed table; beyond this many rows it is joined by shuffle instead of broadcast.
SYSTEMS_BROADCAST_ROWS = 10_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def systems_of(systems: DataFrame) -> DataFrame:
    """One row per system name: zone and date order. Of repeated names the smallest values count; null names are dropped."""
    return (
        systems.where(F.col("system_name").isNotNull())
        .groupBy(F.col("system_name").alias("__system"))
        .agg(F.min("zone_id").alias("__zone"), F.min("date_order").alias("__order"))
    )


def json_time_text(doc: Column, path: str) -> Column:
    """The text of a JSON string or number; NULL for anything else."""
    child = F.try_variant_get(doc, path, "variant")
    shape = F.schema_of_variant(child)
    return (
        F.when(shape == "STRING", F.try_variant_get(doc, path, "string"))
        .when(shape.rlike("^(BIGINT|DECIMAL)"), F.try_variant_get(doc, path, "string"))
        .when(shape.rlike("^(DOUBLE|FLOAT)"), F.regexp_replace(F.try_variant_get(doc, path, "decimal(38,9)").cast("string"), r"\.?0+\z", ""))
    )


def event_times(raw_events: DataFrame, systems: DataFrame, numbers: EpochRange) -> DataFrame:
    """arrival, value, utc_ms, canonical, state of every readable record.

    numbers: the years in which bare numbers may lie. state is 'canonical', 'normalised' or 'unresolved'. Null and unparsable raw texts are not readable and give no row; a
    record without occurredAt is unresolved. Repeated arrivals keep their rows; other columns of the input are not used.
    """
    J.allow_repeated_keys(raw_events.sparkSession)
    doc = J.readable(raw_events.select("arrival", "raw"), "raw", "doc")
    seen = doc.select(
        "arrival",
        json_time_text(F.col("doc"), "$.occurredAt").alias("value"),
        J.string_field(F.col("doc"), "$.occurredAt").isNotNull().alias("__is_string"),
        J.string_field(F.col("doc"), "$.source.system").alias("__system"),
    )
    seen = seen.join(small_side(systems_of(systems), SYSTEMS_BROADCAST_ROWS), "__system", "left")
    ms = instant(F.col("value"), zone=F.col("__zone"), date_order=F.col("__order"), numbers=numbers)
    out = seen.select("arrival", "value", "__is_string", F.explode(F.array(ms)).alias("utc_ms"))  # a row generator: the instant is made once
    canonical = F.col("__is_string") & is_canonical(F.col("value")) & F.col("utc_ms").isNotNull()
    state = F.when(canonical, "canonical").when(F.col("utc_ms").isNotNull(), "normalised").otherwise("unresolved")
    return out.select("arrival", "value", "utc_ms", state.alias("state"))


def observation_times(observations: DataFrame) -> DataFrame:
    """insert_seq, observed_at, utc_ms, state of every row; NULL observed_at is 'unresolved'."""
    ms = observed_ms("observed_at")
    state = F.when(F.col("observed_at").isNull(), "unresolved").when(ms == F.col("observed_at"), "canonical").otherwise("normalised")
    return observations.select("insert_seq", "observed_at", ms.alias("utc_ms"), state.alias("state"))


def found_times(raw_events: DataFrame, observations: DataFrame, systems: DataFrame, numbers: EpochRange) -> DataFrame:
    a = event_times(raw_events, systems, numbers).where(F.col("state") == "normalised")
    b = observation_times(observations).where(F.col("state") == "normalised")
    return a.select(F.lit("raw_events").alias("rec_table"), F.col("arrival").alias("rec_key"), "utc_ms").unionByName(
        b.select(F.lit("observations").alias("rec_table"), F.col("insert_seq").alias("rec_key"), "utc_ms")
    )
