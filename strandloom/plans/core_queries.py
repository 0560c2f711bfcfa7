"""Queries of the general problems and, where SQL can say it, their equivalents."""

from __future__ import annotations

from strandloom.functions.instants import EpochRange
from strandloom.operators import drift, features, late, nested, redelivery, times
from strandloom.session import table


#: All true instants of the tables lie in this year (TESTDATA.md, problem 1).
TRUE_YEARS = EpochRange(2025, 2025)


def p1_found(spark, d):
    return times.found_times(table(spark, d, "raw_events"), table(spark, d, "observations"), table(spark, d, "source_systems"), TRUE_YEARS)


def p2_found(spark, d):
    return nested.elements(table(spark, d, "raw_events"))


def p2_tables(spark, d):
    """The tables the records fall into, with their parents, fields and types."""
    return nested.catalogue(table(spark, d, "raw_events"))


def p2_actors(spark, d):
    """The actors of all records as a typed table."""
    return nested.flat_table(table(spark, d, "raw_events"), "actors[]", {"type": "string", "id": "string"}).drop("rescued")


def p2_jobs(spark, d):
    """A table two arrays deep: the jobs of the stages of pipelines."""
    t = nested.flat_table(table(spark, d, "raw_events"), "payload.stages[].jobs[]", {"runner": "string", "tookMs": "number"})
    return t.drop("rescued")


def p2_steps(spark, d):
    """Three arrays deep, children of p2_jobs: its parent_path is their child_path."""
    t = nested.flat_table(table(spark, d, "raw_events"), "payload.stages[].jobs[].steps[]", {"cmd": "string", "code": "number"})
    return t.drop("rescued")


def p3_features(spark, d):
    return features.wide_features(table(spark, d, "observations"), table(spark, d, "kind_registry"))


def p3_features_long(spark, d):
    return features.long_features(table(spark, d, "observations"), table(spark, d, "kind_registry"))


def p4_found(spark, d):
    return drift.changes(table(spark, d, "raw_events"))


def p4_table(spark, d):
    return drift.consistent(table(spark, d, "raw_events"))


def p6_found(spark, d):
    return late.late_rows(table(spark, d, "observations"))


def p6_hours(spark, d):
    return late.corrected_hours(table(spark, d, "observations"))


def p7_found(spark, d):
    return redelivery.redelivered(table(spark, d, "raw_events"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "p" and k[1].isdigit()}

_MS = """CASE WHEN observed_at < 100000000000 THEN observed_at * 1000 WHEN observed_at < 100000000000000 THEN observed_at
    WHEN observed_at < 100000000000000000 THEN (observed_at + 500) // 1000 ELSE (observed_at::HUGEINT + 500000) // 1000000 END"""

_LONG = f"""
    WITH o AS (SELECT id, obs_type, {_MS} AS ms, actors, attributes, insert_seq, measure_field,
                      row_number() OVER (PARTITION BY id ORDER BY insert_seq) AS rn
               FROM observations JOIN kind_registry USING (obs_type)),
    m AS (SELECT obs_type, ms, actors, CASE WHEN measure_field IS NOT NULL
              THEN try_cast(json_extract_string(attributes, '$.' || measure_field) AS DOUBLE) END AS measure
          FROM o WHERE rn = 1),
    a AS (SELECT DISTINCT * FROM (SELECT row_number() OVER () AS r, * FROM m) t, unnest(actors) AS u(actor)),
    d AS (SELECT DISTINCT r, obs_type, ms, measure, actor.ref_type AS ref_type, actor.ref_id AS ref_id FROM a
          WHERE actor.ref_type IS NOT NULL AND actor.ref_id IS NOT NULL),
    long AS (SELECT ref_type, ref_id, obs_type, count(*) AS n, CAST(max(ms) AS BIGINT) AS latest, sum(measure) AS total FROM d GROUP BY ALL)
"""

# a text that as a whole is an object or array, as that
_OPEN = lambda j: f"""CASE WHEN json_type({j}) = 'VARCHAR' AND regexp_matches(json_extract_string({j}, '$'), '^[ \\t\\r\\n]*[\\[{{]')
    AND json_type(try_cast(json_extract_string({j}, '$') AS JSON)) IN ('OBJECT', 'ARRAY') THEN try_cast(json_extract_string({j}, '$') AS JSON) ELSE {j} END"""  # noqa: E731
_ELEMENTS = f"""
    WITH RECURSIVE e AS (SELECT arrival, try_cast(raw AS JSON) AS j FROM raw_events WHERE json_type(try_cast(raw AS JSON)) = 'OBJECT'),
    t AS (SELECT arrival, f, json_extract(j, '$.' || f) AS v FROM e, (VALUES ('payload'), ('actors'), ('subjects')) AS t(f)),
    s AS (SELECT arrival, f, {_OPEN("v")} AS v FROM t),
    n AS (
        SELECT arrival, CASE WHEN f <> 'payload' AND json_type(v) = 'OBJECT' THEN f || '[0]' ELSE f END AS path, '$' AS parent, f <> 'payload' AND json_type(v) = 'OBJECT' AS is_element, v AS j
        FROM s WHERE json_type(v) IN ('OBJECT', 'ARRAY')
        UNION ALL
        SELECT arrival, path || c.p, CASE WHEN is_element AND json_type(j) = 'OBJECT' THEN path ELSE parent END, json_type(j) = 'ARRAY', c.v
        FROM (SELECT arrival, path, parent, is_element, j, u.c AS x FROM n, unnest(CASE WHEN json_type(j) = 'OBJECT'
                  THEN list_transform(json_keys(j), lambda k: {{'p': '.' || k, 'v': json_extract(j, '$."' || k || '"')}})
                  ELSE list_transform(range(json_array_length(j)::BIGINT), lambda i: {{'p': '[' || i || ']', 'v': json_extract(j, '$[' || i || ']')}}) END) AS u(c)) q,
             LATERAL (SELECT {{'p': q.x.p, 'v': {_OPEN("q.x.v")}}} AS c) w
        WHERE json_type(c.v) IN ('OBJECT', 'ARRAY')),
    l AS (SELECT arrival, path AS child_path, parent AS parent_path, j FROM n WHERE is_element AND json_type(j) = 'OBJECT')
"""
_POSITION = "CAST(regexp_extract(child_path, '\\[(\\d+)\\]$', 1) AS INTEGER) AS position"
_TEXT = lambda f: f"CASE WHEN json_type(j, '$.{f}') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(j, '$.{f}') END AS {f}"
_NUMBER = lambda f: f"CASE WHEN json_type(j, '$.{f}') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN try_cast(json_extract_string(j, '$.{f}') AS DOUBLE) END AS \"{f}\""
_AT = lambda path, cells: _ELEMENTS + f"SELECT arrival, child_path, parent_path, {_POSITION}, {cells} FROM l WHERE regexp_replace(child_path, '\\[\\d+\\]', '[]', 'g') = '{path}'"
_TYPE = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END"

ORACLES = {
    "p2_found": _ELEMENTS + "SELECT arrival, child_path, parent_path FROM l",
    "p2_tables": _ELEMENTS + f""", f AS (SELECT regexp_replace(child_path, '\\[\\d+\\]', '[]', 'g') AS table_path, regexp_replace(parent_path, '\\[\\d+\\]', '[]', 'g') AS parent_table,
                    k AS field_name, json_extract(j, '$."' || k || '"') AS v
             FROM (SELECT *, unnest(CASE WHEN len(json_keys(j)) = 0 THEN [NULL] ELSE json_keys(j) END) AS k FROM l) q)
        SELECT table_path, parent_table, field_name, CASE WHEN field_name IS NOT NULL THEN {_TYPE} END AS json_type, count(*) AS n FROM f GROUP BY ALL""",
    "p2_actors": _AT("actors[]", _TEXT("type") + ", " + _TEXT("id")),
    "p2_jobs": _AT("payload.stages[].jobs[]", _TEXT("runner") + ", " + _NUMBER("tookMs")),
    "p2_steps": _AT("payload.stages[].jobs[].steps[]", _TEXT("cmd") + ", " + _NUMBER("code")),
    "p3_features_long": _LONG + "SELECT * FROM long",
    "p3_features": _LONG + """, who AS (SELECT DISTINCT ref_type, ref_id FROM long), kinds AS (SELECT DISTINCT obs_type FROM kind_registry WHERE obs_type IS NOT NULL),
        grid AS (SELECT ref_type, ref_id, obs_type, coalesce(n, 0) AS n, latest, total FROM who CROSS JOIN kinds LEFT JOIN long USING (ref_type, ref_id, obs_type))
        SELECT * FROM (PIVOT grid ON obs_type USING max(n) AS "count", max(latest) AS latest, max(total) AS total GROUP BY ref_type, ref_id)""",
    "p6_found": f"""
        WITH o AS (SELECT insert_seq, ingested_at, CAST({_MS} AS BIGINT) AS ms FROM observations),
        e AS (SELECT insert_seq, ingested_at, (ms // 3600000 + 1) * 3600000 AS over FROM o WHERE ms IS NOT NULL)
        SELECT insert_seq, CASE WHEN ingested_at <= over + 172800000 THEN 'correction' ELSE 'too_late' END AS verdict
        FROM e WHERE ingested_at >= over""",
    "p6_hours": f"""
        WITH o AS (SELECT ingested_at, CAST({_MS} AS BIGINT) AS ms FROM observations WHERE observed_at IS NOT NULL AND ingested_at IS NOT NULL),
        h AS (SELECT ms // 3600000 * 3600000 AS hour_start, ingested_at FROM o)
        SELECT hour_start, count(*) FILTER (ingested_at < hour_start + 3600000) AS on_time,
               count(*) FILTER (ingested_at >= hour_start + 3600000) AS corrections, count(*) AS total
        FROM h WHERE ingested_at <= hour_start + 176400000 GROUP BY hour_start""",
    "p7_found": """
        WITH r AS (SELECT arrival, try_cast(raw AS JSON) AS j FROM raw_events),
        e AS (SELECT arrival, json_extract_string(j, '$.eventId') AS id FROM r
              WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.eventId') = 'VARCHAR' AND json_extract_string(j, '$.eventId') <> ''),
        m AS (SELECT id, min(arrival) AS kept_arrival FROM e GROUP BY id)
        SELECT m.kept_arrival, e.arrival AS copy_arrival FROM e JOIN m USING (id) WHERE e.arrival > m.kept_arrival""",
}
