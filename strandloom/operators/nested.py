"""Problem 2: deeply nested records as flat related tables that keep parent-child links.

A higher-order projection walks each record level by level: nested ``transform`` calls attach the path so far and the
nearest enclosing array element, ``flatten`` joins the children of a level, and one generator emits the rows. No schema is
needed, so renamed and new fields are walked as well. A pass walks LEVELS levels; what lies deeper is carried over to
another pass, so depth is not limited by the program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import jsontext as J
from strandloom.functions.instants import let
from strandloom.session import written

#: Levels of containers walked in one pass.
LEVELS = 12

#: A JSON text holds a string that may be an object or array itself only if a quote is followed by a bracket.
_MAYBE_EMBEDDED = r'"(?:[ \t]|\\[tnr]|\\u00(?:20|09|0[aAdD]))*(?:[\[{]|\\u00(?:5[bB]|7[bB]))'

_EMIT = "array<struct<child_path:string,parent_path:string,value:string>>"


def maybe_embedded(raw: Column) -> Column:
    return raw.rlike(_MAYBE_EMBEDDED)


def opened(value: Column, embedded: Column) -> Column:
    """A string that as a whole is a JSON object or array as that value; anything else as it is."""
    text = F.when(embedded & (F.schema_of_variant(value) == "STRING"), F.try_variant_get(value, "$", "string"))
    inner = let(text, lambda t: F.when(J.opens_container(t), J.strict_value(t)))
    return F.when(embedded, F.coalesce(inner, value)).otherwise(value)


def _node(path: Column, parent: Column, is_element: Column, value: Column, embedded: Column, values: bool) -> Column:
    """path, parent, own (what its children's nearest element is), m (its fields), a (its items), emit, json."""

    def build(v: Column) -> Column:
        return let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: node(v, m))

    def node(v: Column, m: Column) -> Column:
        emit = is_element & m.isNotNull()
        return F.struct(
            path.alias("path"), parent.alias("parent"), F.when(emit, path).otherwise(parent).alias("own"), m.alias("m"),
            F.when(m.isNull(), F.try_variant_get(v, "$", "array<variant>")).alias("a"), emit.alias("emit"),
            (F.when(emit, F.to_json(v)) if values else F.lit(None).cast("string")).alias("json"),
        )

    return let(opened(value, embedded), build)


def _containers(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["m"].isNotNull() | n["a"].isNotNull())


def _children(n: Column, embedded: Column, values: bool) -> Column:
    join = lambda *parts: F.concat(n["path"], *parts)
    fields = F.transform(F.map_entries(n["m"]), lambda e: _node(join(F.lit("."), e["key"]), n["own"], F.lit(False), e["value"], embedded, values))
    items = F.transform(
        n["a"], lambda x, i: _node(join(F.lit("["), i.cast("string"), F.lit("]")), n["own"], F.lit(True), x, embedded, values)
    )
    return _containers(F.coalesce(fields, items))


def _found(nodes: Column) -> Column:
    return F.transform(
        F.filter(nodes, lambda n: n["emit"]), lambda n: F.struct(n["path"].alias("child_path"), n["parent"].alias("parent_path"), n["json"].alias("value"))
    )


def _walk(df: DataFrame, levels: int, values: bool) -> DataFrame:
    """arrival, embedded, rows, rest: of the nodes in ``ns``, the elements of ``levels`` levels and what lies below.

    A level is a projection of its own: the nodes are used twice in the next one, so the optimizer keeps them apart.
    """
    df = df.withColumn("rows", F.array().cast(_EMIT))
    level = [
        F.col("arrival"), F.col("embedded"), F.concat("rows", _found(F.col("ns"))).alias("rows"),
        F.flatten(F.transform("ns", lambda n: _children(n, F.col("embedded"), values))).alias("ns"),
    ]
    for _ in range(levels):
        df = df.select(*level)
    content = lambda n: F.coalesce(F.to_json(n["m"]), F.to_json(n["a"]))
    rest = F.transform(
        "ns", lambda n: F.struct(n["path"].alias("path"), n["parent"].alias("parent"), n["emit"].alias("emit"), content(n).alias("json"))
    )
    return df.select("arrival", "embedded", "rows", rest.alias("rest"))


def refs_of(build):
    return lambda v: build(v)


def _roots(doc: Column, embedded: Column, values: bool) -> Column:
    """The top nodes of a record: payload, actors, subjects. A single object instead of refs counts as an array of one."""
    root, none = F.lit("$"), F.lit(False)
    nodes = [_node(F.lit("payload"), root, none, F.try_variant_get(doc, "$.payload", "variant"), embedded, values)]
    for name in ("actors", "subjects"):

        def refs(v: Column, name: str = name) -> Column:
            single = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
            return F.when(single, _node(F.lit(f"{name}[0]"), root, F.lit(True), v, none, values)).otherwise(_node(F.lit(name), root, none, v, none, values))

        nodes.append(F.transform(F.array(opened(F.try_variant_get(doc, f"$.{name}", "variant"), embedded)), refs_of(refs))[0])
    return _containers(F.array(*nodes))


def elements(raw_events: DataFrame, values: bool = False) -> DataFrame:
    """arrival, child_path, parent_path (and value, its JSON, if asked for) of every object that is an array element.

    Paths are written like ``payload.a[0].b[2]``, positions counting nulls too; parent_path is the nearest enclosing such
    object or ``$``. Unreadable and null texts, missing, null or scalar payloads and empty arrays give no rows. Strings
    that as a whole are JSON objects or arrays are walked like these. Keys are written as they are.
    """
    J.allow_repeated_keys(raw_events.sparkSession)
    flagged = raw_events.select("arrival", "raw", maybe_embedded(F.col("raw")).alias("embedded"))
    doc = J.readable(flagged, "raw", "doc")
    start = doc.select("arrival", "embedded", _roots(F.col("doc"), F.col("embedded"), values).alias("ns"))
    passes = [written(_walk(start, LEVELS, values), "elements")]
    while not (rest := passes[-1].where(F.size("rest") > 0)).isEmpty():
        seeds = F.transform("rest", lambda n: _node(n["path"], n["parent"], n["emit"], F.try_parse_json(n["json"]), F.col("embedded"), values))
        passes.append(written(_walk(rest.select("arrival", "embedded", seeds.alias("ns")), LEVELS, values), "elements"))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    rows = out.select("arrival", F.inline("rows"))
    return rows if values else rows.drop("value")


def table_path() -> Column:
    """The table an element belongs to: its path without positions."""
    return F.regexp_replace("child_path", r"\[\d+\]", "[]")


def catalogue(raw_events: DataFrame) -> DataFrame:
    """table_path, parent_table, field_name, json_type, n: every table the records hold, its fields and the types they come in.

    A table is the objects at one path without positions, e.g. payload.stages[].jobs[]; its parent is the table of the nearest
    enclosing elements, or ``$`` for the record. Objects without fields give their table a row with NULL field_name. A text
    that as a whole is an object or array is a string here; what it holds has tables of its own.
    """
    rows = elements(raw_events, values=True).select(table_path().alias("table_path"), F.regexp_replace("parent_path", r"\[\d+\]", "[]").alias("parent_table"), "value")
    m = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    fields = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("field_name"), J.kind_of(e["value"]).alias("json_type")))
    return rows.select("table_path", "parent_table", F.explode_outer(fields).alias("f")).groupBy("table_path", "parent_table", "f.field_name", "f.json_type").agg(F.count("*").alias("n"))


#: SQL types of JSON types; objects and arrays are columns of JSON text.
_SQL = {"string": "string", "number": "double", "boolean": "boolean"}


def _reached(value: Column, keys: str, embedded: Column) -> Column:
    """The value below ``value`` at keys like ``.a.b``, opening texts that are objects or arrays on the way."""
    def child(key: str):
        return lambda v: F.try_variant_get(v, f"$['{key}']", "variant")

    for key in filter(None, keys.split(".")):
        value = let(opened(value, embedded), child(key))
    return opened(value, embedded)


def flat_table(raw_events: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
    """One typed table: arrival, child_path, parent_path, position, a column for each of ``columns``, rescued.

    path: of the elements, e.g. payload.stages[].jobs[]. Nested transforms walk straight down to it, attaching the ancestor's
    path and the position at each array; flatten joins what they find, and one inline emits the rows. columns: field names and
    JSON types; numbers are also texts, and numeric texts numbers. rescued holds as JSON every other field and every value
    of another type. Elements that are no objects are counted by position and give no row. A field named like one of the
    fixed columns gets a trailing underscore.
    """
    J.allow_repeated_keys(raw_events.sparkSession)
    flagged = raw_events.select("arrival", "raw", maybe_embedded(F.col("raw")).alias("embedded"))
    doc, embedded = J.readable(flagged, "raw", "doc"), F.col("embedded")
    first, *steps = path.removesuffix("[]").split("[]")
    refs = first in ("actors", "subjects")
    fixed = {"arrival", "child_path", "parent_path", "position", "rescued"}
    names = {f: f + "_" if f.lower() in fixed else f for f in columns}

    def fits(v: Column, kind: str) -> Column:
        k = J.kind_of(v)
        also = {"string": k == "number", "number": (k == "string") & F.try_variant_get(v, "$", "double").isNotNull()}.get(kind, F.lit(False))
        return F.coalesce((k == kind) | also, F.lit(False))

    def row(v: Column, m: Column, at: Column, parent: Column, i: Column) -> Column:
        cells = []
        for f, kind in columns.items():
            cell = F.try_element_at(m, F.lit(f))
            cells.append(F.when(fits(cell, kind), F.try_variant_get(cell, "$", _SQL[kind]) if kind in _SQL else F.to_json(cell)).alias(names[f]))
        other = F.map_filter(m, lambda k, x: ~F.coalesce(*[F.when(k == f, fits(x, kind)) for f, kind in columns.items()], F.lit(False)))
        return F.struct(at.alias("child_path"), parent.alias("parent_path"), i.alias("position"), *cells, F.when(F.size(other) > 0, F.to_json(other)).alias("rescued"))

    def below(items: Column, at: Column, parent: Column, rest: list[str]) -> Column:
        def one(x: Column, i: Column) -> Column:
            here = F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))

            def inside(v: Column) -> Column:
                as_map = F.try_variant_get(v, "$", "map<string,variant>")
                if not rest:
                    return F.filter(F.array(let(as_map, lambda m: F.when(m.isNotNull(), row(v, m, here, parent, i)))), lambda r: r.isNotNull())
                own = F.when(J.is_object(v), here).otherwise(parent)
                nested = F.try_variant_get(_reached(v, rest[0], embedded), "$", "array<variant>")
                return below(nested, F.concat(here, F.lit(rest[0])), own, rest[1:])

            return let(opened(x, embedded), inside)

        # an element without the array below it has no rows; flatten would lose all for it
        return F.flatten(F.filter(F.transform(items, one), lambda r: r.isNotNull()))

    def start(v: Column) -> Column:
        several = F.try_variant_get(v, "$", "array<variant>")
        return F.when(J.is_object(v), F.array(v)).otherwise(several) if refs and first == path.split("[")[0] else several

    top = _reached(F.col("doc"), "." + first, embedded)
    found = let(let(top, start), lambda items: below(items, F.lit(first), F.lit("$"), steps))
    return doc.select("arrival", F.inline(found))


def flat_tables(raw_events: DataFrame, max_tables: int = 2_000) -> dict[str, DataFrame]:
    """Every table of :func:`catalogue` as a typed frame, by its path; a field has the type it most often comes in.

    More tables than ``max_tables`` are as many plans, so that is an error; :func:`elements` then holds them all in one long table.
    """
    counts = catalogue(raw_events).where((F.col("json_type") != "null") | F.col("field_name").isNull()).groupBy("table_path", "field_name")
    best = counts.agg(F.max_by("json_type", F.struct("n", "json_type")).alias("json_type")).groupBy("table_path")
    listed = best.agg(F.collect_list(F.struct("field_name", "json_type")).alias("fields")).orderBy("table_path").limit(max_tables + 1).collect()
    if len(listed) > max_tables:
        raise ValueError(f"more than {max_tables} tables")
    return {r["table_path"]: flat_table(raw_events, r["table_path"], {f["field_name"]: f["json_type"] for f in sorted(r["fields"], key=str) if f["field_name"] is not None}) for r in listed}
