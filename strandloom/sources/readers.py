"""Events from text files: one JSON array, or one event a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import jsontext as J
from strandloom.operators.ordering import with_running_sum

#: The white space that is trimmed off texts and lines.
_BLANK = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(text: Column) -> Column:
    """Without white space at both ends: tabs, carriage returns and Unicode spaces as well as blanks."""
    return F.regexp_replace(text, rf"\A{_BLANK}|{_BLANK}\z", "")


def _events_of_lines(lines: DataFrame) -> DataFrame:
    """arrival, raw of lines (at: their order, value)."""
    J.allow_repeated_keys(lines.sparkSession)
    some = lines.select(trimmed(F.col("value")).alias("raw"), "at", F.lit(1).alias("one"))
    kept = with_running_sum(some.where(F.length("raw") > 0), "at", "one", "arrival")
    good = J.is_whole(J.wrapped(F.col("raw")), F.col("raw"))
    fail = F.raise_error(F.concat(F.lit("invalid JSON on line "), (F.col("arrival") + 1).cast("string")))
    return kept.select("arrival", F.when(good, F.col("raw")).otherwise(fail.cast("string")).alias("raw"))


def _events_of_array(whole: DataFrame) -> DataFrame:
    """arrival, raw of the elements of the array that the one row of ``whole`` (value) holds."""
    J.allow_repeated_keys(whole.sparkSession)
    items = F.try_variant_get(J.strict_value(trimmed(F.col("value"))), "$", "array<variant>")
    fail = F.raise_error(F.lit("top-level JSON must be an array of events")).cast("array<string>")
    texts = whole.select(F.posexplode(F.when(items.isNotNull(), F.transform(items, lambda x: F.to_json(x))).otherwise(fail)).alias("arrival", "raw"))
    return texts.select(F.col("arrival").cast("bigint").alias("arrival"), "raw")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """arrival, raw of the non-blank lines in file order. A line that is no JSON fails the read, naming its number among the
    non-blank lines. Files without lines give no rows."""
    return _events_of_lines(spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("at")))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """arrival, raw of the elements of one JSON array; its place is the arrival."""
    return _events_of_array(spark.read.text(path, wholetext=True))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One array if the text starts with a bracket, else NDJSON."""
    first = spark.read.text(path).select(trimmed(F.col("value")).alias("v")).where(F.length("v") > 0).first()
    if first is not None and first["v"].startswith("["):
        return read_array(spark, path)
    return read_ndjson(spark, path)


def events_of_text(spark: SparkSession, text: str) -> DataFrame:
    """The same for a text the driver holds, as from standard input."""
    if text.strip().startswith("["):
        return _events_of_array(spark.createDataFrame([(text,)], "value string"))
    return _events_of_lines(spark.createDataFrame(list(enumerate(text.split("\n"))), "at bigint, value string"))
