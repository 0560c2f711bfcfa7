"""Problem 4: schemas that drift between files. One consistent table with a rescue column, and a list of every change.

Ingestion enforces a target schema: a field of the expected type goes to its column, anything unknown or of another type
is kept as JSON in ``rescued``. Fields that come later are promoted: their rescued values are replayed into typed columns.
The target schema is made of all fields the files carry; a field that a connector renamed is read under the name it has in
the file. Changes come from the fields of each file against its connector's file before, both reduced to (file, field,
type) rows, so the comparison is one aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import jsontext as J
from strandloom.functions.instants import let
from strandloom.operators.nested import maybe_embedded, opened
from strandloom.session import written

#: Top-level keys that are not watched.
UNWATCHED = ("eventId", "kind", "occurredAt", "source", "actors", "subjects")
#: Levels of containers walked in one pass.
LEVELS = 10
#: Columns of the consistent table at most; more is an error, not a cut.
MAX_COLUMNS = 5_000

#: The types a field can have in a file, in the order in which several are named.
_TYPES = ("array", "boolean", "number", "object", "string")

_ROWS = "array<struct<field_path:string,type:string>>"


def _node(path: Column, is_field: Column, value: Column, embedded: Column) -> Column:
    """path, type (of a field), m, a."""

    def build(v: Column) -> Column:
        return let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: let(F.when(m.isNull(), F.try_variant_get(v, "$", "array<variant>")), lambda a: node(v, m, a)))

    def node(v: Column, m: Column, a: Column) -> Column:
        kind = F.when(m.isNotNull(), "object").when(a.isNotNull(), "array").otherwise(J.kind_of(v))
        return F.struct(path.alias("path"), F.when(is_field, kind).alias("type"), m.alias("m"), a.alias("a"))

    return let(opened(value, embedded), build)


def _children(n: Column, embedded: Column) -> Column:
    fields = F.transform(F.map_entries(n["m"]), lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), F.lit(True), e["value"], embedded))
    items = F.transform(n["a"], lambda x: _node(F.concat(n["path"], F.lit("[]")), F.lit(False), x, embedded))
    return F.coalesce(fields, items)


def _fields(nodes: Column) -> Column:
    some = F.filter(nodes, lambda n: n["type"].isNotNull())
    return F.array_distinct(F.transform(some, lambda n: F.struct(n["path"].alias("field_path"), n["type"].alias("type"))))


def _walk(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    keep = ["batch_id", "connector", "embedded"]
    listed = [F.concat("rows", _fields(F.col("ns"))).alias("rows"), F.filter("ns", lambda n: n["m"].isNotNull() | n["a"].isNotNull()).alias("ns")]
    deeper = F.flatten(F.transform("ns", lambda n: _children(n, F.col("embedded")))).alias("ns")
    for _ in range(levels):
        df = df.select(*keep, *listed).select(*keep, "rows", deeper)
    below = F.filter("ns", lambda n: n["m"].isNotNull() | n["a"].isNotNull())
    rest = F.transform(below, lambda n: F.struct(n["path"].alias("path"), F.coalesce(F.to_json(n["m"]), F.to_json(n["a"])).alias("json")))
    return df.select(*keep, F.concat("rows", _fields(F.col("ns"))).alias("rows"), rest.alias("rest"))


def record_fields(raw_events: DataFrame, levels: int | None = None) -> DataFrame:
    """batch_id, connector, rows: the watched fields of every readable record with the type it has there.

    levels: how far below the record's own keys is walked, to the end if None.
    """
    J.allow_repeated_keys(raw_events.sparkSession)
    flagged = raw_events.select("batch_id", "raw", maybe_embedded(F.col("raw")).alias("embedded"))
    doc, embedded = J.readable(flagged, "raw", "doc"), F.col("embedded")
    source = opened(F.try_variant_get("doc", "$.source", "variant"), embedded)
    top = F.map_filter(F.try_variant_get("doc", "$", "map<string,variant>"), lambda k, _: ~k.isin(*UNWATCHED))
    below = lambda e: F.when(e["key"] == "payload", opened(e["value"], embedded)).otherwise(e["value"])
    seeds = F.transform(F.map_entries(top), lambda e: _node(e["key"], F.lit(True), below(e), F.when(e["key"] == "payload", embedded).otherwise(F.lit(False))))
    # of the top-level fields only payload is walked into
    cut = F.transform(
        seeds,
        lambda n: F.struct(
            n["path"].alias("path"), n["type"].alias("type"), F.when(n["path"] == "payload", n["m"]).alias("m"), F.when(n["path"] == "payload", n["a"]).alias("a")
        ),
    )
    start = doc.select(
        "batch_id", let(source, lambda s: J.string_field(s, "$.connector")).alias("connector"), "embedded", F.array().cast(_ROWS).alias("rows"), cut.alias("ns")
    )
    if levels is not None:
        return written(_walk(start, levels).select("batch_id", "connector", "rows"), "fields")
    passes = [written(_walk(start), "fields")]
    while not (rest := passes[-1].where(F.size("rest") > 0)).isEmpty():
        nodes = F.transform("rest", lambda n: _node(n["path"], F.lit(False), F.try_parse_json(n["json"]), embedded))
        passes.append(written(_walk(rest.select("batch_id", "connector", "embedded", F.array().cast(_ROWS).alias("rows"), nodes.alias("ns"))), "fields"))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.select("batch_id", "connector", "rows")


def file_fields(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch_id, field_path, type) and (batch_id, connector, next_id): next_id is the connector's following file.

    A field that is null throughout a file is there but has no type; one with several types in a file has them joined by
    '|'. Files without a readable record, and those whose records all omit the connector, cannot be compared.
    """
    rows = records.select("batch_id", F.inline("rows"))
    bit = F.coalesce(*[F.when(F.col("type") == t, 1 << i) for i, t in enumerate(_TYPES)], F.lit(0))
    fields = rows.groupBy("batch_id", "field_path").agg(F.bit_or(bit).alias("bits"))
    joined = F.concat_ws("|", *[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, t) for i, t in enumerate(_TYPES)])
    fields = fields.select("batch_id", "field_path", F.when(F.col("bits") != 0, joined).alias("type"))
    files = records.where(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.min("connector").alias("connector")).where(F.col("connector").isNotNull())
    order = Window.partitionBy("connector").orderBy("batch_id")
    return fields, files.select("batch_id", "connector", F.lead("batch_id").over(order).alias("next_id"), (F.row_number().over(order) > 1).alias("has_before"))


def changes(raw_events: DataFrame) -> DataFrame:
    """batch_id, field_path, change_kind, new_path: every change of a file against its connector's file before.

    Nothing below a listed field is listed. A field that goes and one that comes under the same parent with the same type
    are one rename; if several go and come there, they are paired in order of their names and the rest stay as they are.
    """
    return compared(*file_fields(record_fields(raw_events)))


def compared(fields: DataFrame, files: DataFrame) -> DataFrame:
    """:func:`changes` from the two results of :func:`file_fields`."""
    # both sides grow with the data: never sent to all tasks
    known = fields.join(files.hint("merge"), "batch_id")
    sides = known.where("has_before").select(F.col("batch_id").alias("file"), "field_path", "type", F.lit(1).alias("now"))
    sides = sides.unionByName(
        known.where(F.col("next_id").isNotNull()).select(F.col("next_id").alias("file"), "field_path", "type", F.lit(0).alias("now"))
    )
    both = sides.groupBy("file", "field_path").agg(
        F.max("now").alias("now"), F.min("now").alias("old"),
        F.max(F.when(F.col("now") == 1, F.col("type"))).alias("new_type"), F.max(F.when(F.col("now") == 0, F.col("type"))).alias("old_type"),
    )
    kind = (
        F.when(F.col("now") == 0, "removed").when(F.col("old") == 1, "added").when(F.col("new_type") != F.col("old_type"), "type_changed")
    )
    listed = both.withColumn("kind", kind).where(F.col("kind").isNotNull())
    listed = written(
        listed.select("file", "field_path", "kind", F.coalesce("old_type", F.lit("")).alias("old_type"), F.coalesce("new_type", F.lit("")).alias("new_type")), "listed"
    )
    # a path is below another that ends where one of its keys or brackets begins; these are looked up, however many a file has
    ends = F.filter(F.sequence(F.lit(1), F.length("field_path")), lambda i: F.substr("field_path", i, F.lit(1)).isin(".", "["))
    above = listed.select("file", "field_path", F.explode(F.transform(ends, lambda i: F.substr("field_path", F.lit(1), i - 1))).alias("above"))
    covered = above.join(listed.select("file", F.col("field_path").alias("above")).hint("merge"), ["file", "above"], "left_semi").select("file", "field_path").distinct()
    flat = listed.join(covered.hint("merge"), ["file", "field_path"], "left_anti")
    parent = F.when(F.instr("field_path", ".") > 0, F.regexp_replace("field_path", r"\.[^.]*\z", "")).otherwise("")
    flat = flat.withColumn("parent", parent).withColumn("type", F.when(F.col("kind") == "removed", F.col("old_type")).otherwise(F.col("new_type")))
    moved = flat.where(F.col("kind") != "type_changed")
    slot = F.row_number().over(Window.partitionBy("file", "parent", "type", "kind").orderBy("field_path"))
    untyped = F.when(F.col("type") == "", F.col("field_path")).otherwise("")  # null tells nothing: such fields are never paired
    pairs = moved.withColumn("slot", slot).withColumn("untyped", untyped).groupBy("file", "parent", "type", "slot", "untyped").agg(
        F.max(F.when(F.col("kind") == "removed", F.col("field_path"))).alias("gone"), F.max(F.when(F.col("kind") == "added", F.col("field_path"))).alias("come")
    )
    renamed = F.col("gone").isNotNull() & F.col("come").isNotNull()
    moves = pairs.select(
        F.col("file").alias("batch_id"), F.coalesce("gone", "come").alias("field_path"),
        F.when(renamed, "renamed").when(F.col("come").isNull(), "removed").otherwise("added").alias("change_kind"),
        F.when(renamed, F.col("come")).otherwise("").alias("new_path"),
    )
    retyped = flat.where(F.col("kind") == "type_changed")
    return moves.unionByName(retyped.select(F.col("file").alias("batch_id"), "field_path", F.col("kind").alias("change_kind"), F.lit("").alias("new_path")))


@dataclass(frozen=True)
class Target:
    """A column of the consistent table: where it is read from (key of the record or of payload) and its JSON type."""

    column: str
    key: str
    type: str
    in_payload: bool = True

    @property
    def sql_type(self) -> str:
        return {"string": "string", "number": "double", "boolean": "boolean"}.get(self.type, "string")


#: Paths of fields that are columns: keys of the record, and of payload.
_COLUMN_PATH = r"\A(?:payload\.)?[^.\[]+\z"
#: Columns every row has besides its fields.
_FIXED = ("arrival", "batch_id", "rescued")


def names_by_file(change_list: DataFrame, files: DataFrame) -> DataFrame:
    """batch_id, names: for each file with renamed fields, the first path of the field by the path it has in that file.

    Renames are followed within their connector only, from the file where they set in through its later files.
    """
    renames = change_list.where((F.col("change_kind") == "renamed") & F.col("field_path").rlike(_COLUMN_PATH)).select("batch_id", "field_path", "new_path")
    renames = renames.join(files.select("batch_id", "connector"), "batch_id")

    def follow(pdf):
        names: dict[str, str] = {}
        out = []
        for batch, some in pdf.sort_values(["batch_id", "field_path"]).groupby("batch_id"):
            for old, new in zip(some["field_path"], some["new_path"], strict=True):
                names[new] = names.get(old, old)
                if names[new] == new:  # back to its first name
                    del names[new]
            out.append((batch, list(names), list(names.values())))
        return type(pdf)(out, columns=["batch_id", "new", "first"])

    known = renames.groupBy("connector").applyInPandas(follow, "batch_id bigint, new array<string>, first array<string>")
    at = files.select("batch_id", "connector").join(known.select("batch_id", F.map_from_arrays("new", "first").alias("names")), "batch_id", "left")
    so_far = F.last("names", ignorenulls=True).over(Window.partitionBy("connector").orderBy("batch_id"))
    return at.select("batch_id", so_far.alias("names")).where(F.size("names") > 0)


def column_targets(fields: DataFrame, files: DataFrame, names: DataFrame) -> tuple[list[Target], list[Target]]:
    """A target for each field of the record and of payload: those of the connectors' first files, and those that came later.

    A column's type is the one that most files give the field (of equally many the first by name); values of other types
    that can't be cast stay in rescued. A field that is null in all files is a string.
    """
    own = fields.where(F.col("field_path").rlike(_COLUMN_PATH) & (F.col("field_path") != "payload")).join(names, "batch_id", "left")
    own = own.join(files.select("batch_id", (~F.col("has_before")).alias("is_first")), "batch_id", "left")
    path = F.coalesce(F.try_element_at("names", F.col("field_path")), "field_path")
    kinds = own.select(path.alias("path"), F.explode(F.split(F.coalesce("type", F.lit("")), r"\|")).alias("type"), F.coalesce("is_first", F.lit(False)).alias("is_first"))
    kinds = kinds.groupBy("path", "type").agg(F.count("*").alias("n"), F.max("is_first").alias("is_first"))
    best = F.max_by("type", F.struct(F.col("type") != "", "n", F.transform(F.split("type", ""), lambda c: -F.ascii(c))))
    rows = kinds.groupBy("path").agg(best.alias("type"), F.max("is_first").alias("is_first")).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    used, first, later = set(_FIXED), [], []
    for r in sorted(rows, key=lambda r: (r["path"].startswith("payload."), r["path"])):
        in_payload, key = r["path"].startswith("payload."), r["path"].removeprefix("payload.")
        column = next(n for n in _column_names(key, in_payload) if n not in used)
        used.add(column)
        (first if r["is_first"] else later).append(Target(column, key, r["type"] or "string", in_payload))
    return first, later


def _column_names(key: str, in_payload: bool) -> Iterator[str]:
    """Names for a key, best first: durationMs is duration_ms. Columns are compared without case."""
    plain = re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key)).lower()
    yield plain
    yield (plain := f"{'payload' if in_payload else 'record'}_{plain}")
    n = 2
    while True:
        yield f"{plain}_{n}"
        n += 1


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _fits(v: Column, wanted: Column) -> Column:
    """Whether ``v`` can be cast to the JSON type ``wanted``: numbers are also texts, and numeric texts numbers."""
    fit = lambda kind: (kind == wanted) | ((wanted == "string") & (kind == "number")) | ((wanted == "number") & (kind == "string") & _number(v).isNotNull())
    return F.coalesce(let(J.kind_of(v), fit), F.lit(False))


def _split(m: Column, prefix: str, targets: list[Target], names: Column, kept: tuple[str, ...] = ()) -> Column:
    """taken: the entries of ``m`` that targets take, by the target's key; left: the others as JSON, NULL if there are none.

    If a record has a field under two of its names, the first name counts and the other stays among the others.
    """
    types = F.create_map(*[F.lit(x) for t in targets for x in (t.key, t.type)]) if targets else F.lit(None).cast("map<string,string>")
    left = lambda rest: F.when(F.size(rest) > 0, F.to_json(rest))
    watched = F.map_filter(m, lambda k, _: ~k.isin(*kept)) if kept else m
    fits = lambda k, v: _fits(v, F.try_element_at(types, k))

    def plain(w: Column) -> Column:
        taken = F.map_filter(w, fits)
        return let(taken, lambda t: F.struct(t.alias("taken"), left(F.map_filter(w, lambda k, _: ~F.map_contains_key(t, k))).alias("left")))

    def renamed(w: Column) -> Column:
        first = lambda k: F.coalesce(F.substr(F.try_element_at(names, F.concat(F.lit(prefix), k)), F.lit(len(prefix) + 1)), k)
        entries = F.transform(F.map_entries(w), lambda e: F.struct(first(e["key"]).alias("field"), e["key"].alias("key"), e["value"].alias("value")))
        fitting = F.filter(entries, lambda e: fits(e["field"], e["value"]))
        return let(fitting, lambda es: picked(w, es))

    def picked(w: Column, es: Column) -> Column:
        before = lambda y, x: (y["field"] == x["field"]) & (F.struct(y["key"] != y["field"], y["key"]) < F.struct(x["key"] != x["field"], x["key"]))
        best = F.filter(es, lambda x: ~F.exists(es, lambda y: before(y, x)))
        taken = lambda b: F.map_from_entries(F.transform(b, lambda e: F.struct(e["field"], e["value"])))
        rest = lambda b: F.map_filter(w, lambda k, _: ~F.exists(b, lambda e: e["key"] == k))
        return let(best, lambda b: F.struct(taken(b).alias("taken"), left(rest(b)).alias("left")))

    return let(watched, lambda w: F.when(names.isNull(), plain(w)).otherwise(renamed(w)))


def _columns(targets: list[Target]) -> list[Column]:
    out = []
    for t in targets:
        v = F.try_element_at("inner_taken" if t.in_payload else "outer_taken", F.lit(t.key))
        out.append((F.to_json(v) if t.type in ("object", "array") else F.try_variant_get(v, "$", t.sql_type)).alias(t.column))
    return out


def _named(df: DataFrame, names: DataFrame | None) -> DataFrame:
    return df.withColumn("names", F.lit(None).cast("map<string,string>")) if names is None else df.join(names, "batch_id", "left")


def _sides(targets: list[Target]) -> tuple[list[Target], list[Target]]:
    return [t for t in targets if not t.in_payload], [t for t in targets if t.in_payload]


def ingest(raw_events: DataFrame, targets: list[Target], names: DataFrame | None = None) -> DataFrame:
    """arrival, batch_id, one column a target, rescued: the readable records under one schema.

    rescued holds as JSON, under the names of the file, what no column took: unknown fields, fields of another type, and
    payloads that are no object. A text that as a whole is a JSON object or array counts as that. names: of :func:`names_by_file`; without it fields are read under their own names only.
    """
    J.allow_repeated_keys(raw_events.sparkSession)
    flagged = raw_events.select("arrival", "batch_id", "raw", maybe_embedded(F.col("raw")).alias("embedded"))
    doc, embedded = J.readable(_named(flagged, names), "raw", "doc"), F.col("embedded")
    top = F.try_variant_get("doc", "$", "map<string,variant>")
    payload = opened(F.try_variant_get("doc", "$.payload", "variant"), embedded)
    outer, inner = _sides(targets)

    def build(p: Column) -> Column:
        m = F.try_variant_get(p, "$", "map<string,variant>")
        m = F.when(embedded, F.transform_values(m, lambda _, v: opened(v, embedded))).otherwise(m)
        return let(_split(top, "", outer, F.col("names"), (*UNWATCHED, "payload")), lambda o: let(_split(m, "payload.", inner, F.col("names")), lambda i: row(p, o, i)))

    def row(p: Column, o: Column, i: Column) -> Column:
        rescued = F.struct(o["left"].alias("record"), F.when(i["taken"].isNull(), F.to_json(p)).otherwise(i["left"]).alias("payload"))
        return F.struct(o["taken"].alias("outer_taken"), i["taken"].alias("inner_taken"), rescued.alias("rescued"))

    rows = doc.select("arrival", "batch_id", F.inline(F.transform(F.array(payload), build)))
    return rows.select("arrival", "batch_id", *_columns(targets), "rescued")


def promote(table: DataFrame, targets: list[Target], names: DataFrame | None = None) -> DataFrame:
    """``table`` of :func:`ingest` with more columns, filled by replaying the rescued values, which then leave ``rescued``."""
    parsed = lambda part: F.try_variant_get(F.try_parse_json(F.col(f"rescued.{part}")), "$", "map<string,variant>")
    outer, inner = _sides(targets)
    keep = [c for c in table.columns if c != "rescued"]

    def row(o: Column, i: Column) -> Column:
        left = lambda part, x: F.when(x["taken"].isNull(), F.col(f"rescued.{part}")).otherwise(x["left"]).alias(part)
        return F.struct(o["taken"].alias("outer_taken"), i["taken"].alias("inner_taken"), F.struct(left("record", o), left("payload", i)).alias("rescued"))

    both = let(_split(parsed("record"), "", outer, F.col("names")), lambda o: let(_split(parsed("payload"), "payload.", inner, F.col("names")), lambda i: row(o, i)))
    named = _named(table, names)
    rows = named.withColumn("row", F.explode(F.array(both))).select(*keep, "row.*")
    return rows.select(*keep, *_columns(targets), "rescued")


def consistent(raw_events: DataFrame) -> DataFrame:
    """One table of all readable records: a column for each field of the record and of payload, and rescued.

    The schema enforced at ingestion has the fields of the connectors' first files; those that came later are promoted.
    """
    fields, files = file_fields(record_fields(raw_events, levels=1))  # whether such a field changed doesn't depend on those below it
    fields, files = written(fields, "file-fields"), written(files, "files")
    names = written(names_by_file(compared(fields, files), files), "names")
    first, later = column_targets(fields, files, names)
    table = ingest(raw_events, first, names)
    return promote(table, later, names) if later else table
