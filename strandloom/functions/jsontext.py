"""Strict JSON reading on top of VARIANT.

``try_parse_json`` stops after the first value and ignores what follows it. Here the text is parsed as the first
element of a two-element array whose second element is the text's own 64-bit hash; only a text that is exactly one JSON
value leaves both elements in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of a key given twice in one object the last value counts, as in other JSON readers."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]")))


def is_whole(wrap: Column, text: Column) -> Column:
    """Whether ``wrap`` (of :func:`wrapped`) shows that ``text`` is one JSON value."""
    return F.coalesce(
        (F.try_variant_get(wrap, "$[1]", "bigint") == F.xxhash64(text)) & F.try_variant_get(wrap, "$[2]", "variant").isNull(),
        F.lit(False),
    )


def opens_object(text: Column) -> Column:
    return text.rlike(r"\A[ \t\r\n]*\{")


def opens_container(text: Column) -> Column:
    return text.rlike(r"\A[ \t\r\n]*[\[{]")


def strict_value(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else NULL."""
    w = wrapped(text)
    return F.when(is_whole(w, text), F.try_variant_get(w, "$[0]", "variant"))


def kind_of(value: Column) -> Column:
    """string, number, boolean, object, array or null of a VARIANT; NULL for an absent one."""
    name = lambda s: (
        F.when(s == "STRING", "string")
        .when(s.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
    )
    return F.transform(F.array(F.schema_of_variant(value)), name)[0]  # the schema is made once


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object; its fields are not looked at. NULL counts as none."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def string_field(doc: Column, path: str) -> Column:
    """The field's text if it is a JSON string; numbers and the like are not turned into text."""
    child = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(child) == "STRING", F.try_variant_get(doc, path, "string"))


def parsed(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``df`` with the VARIANT of ``raw`` in ``out`` instead of the text, NULL where the text is not one JSON object.

    Row generators hold the parsed array and its first element: conditions would otherwise parse the text once for every use.
    """
    keep = [c for c in df.columns if c != raw]
    text = F.col(raw)
    w = df.select(*keep, raw, F.explode(F.array(F.when(opens_object(text), wrapped(text)))).alias("__w"))
    doc = F.when(is_whole(F.col("__w"), text), F.try_variant_get("__w", "$[0]", "variant"))
    return w.select(*keep, F.explode(F.array(doc)).alias(out))


def readable(df: DataFrame, raw: str, out: str) -> DataFrame:
    """The rows whose ``raw`` is one JSON object, with its VARIANT in ``out`` instead of the text; it is parsed once."""
    keep = [c for c in df.columns if c != raw]
    text = F.col(raw)
    w = df.select(*keep, raw, F.explode(F.array(F.when(opens_object(text), wrapped(text)))).alias("__w"))
    return w.where(is_whole(F.col("__w"), text)).select(*keep, F.try_variant_get("__w", "$[0]", "variant").alias(out))
