"""Queries of the problems on texts and, where SQL can say it, their equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import encoding, mixing, reading, seen
from strandloom.session import table


def p5_found(spark, d):
    return seen.repeats(table(spark, d, "seen_keys"), table(spark, d, "observations"))


def p5_error_rates(spark, d):
    return seen.error_rates(table(spark, d, "seen_keys"), table(spark, d, "observations"))


def p8_ids(spark, d):
    return encoding.encoded(table(spark, d, "documents"))


def p8_round_trip(spark, d):
    """Documents whose text does not come back from its ids: should be none; n_documents counts those compared."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = encoding.decoded(encoding.encoded(docs)).withColumnRenamed("text", "back")
    both = docs.join(back, "doc_id")
    return both.agg(F.count("*").alias("n_documents"), F.count_if(F.coalesce("text", F.lit("")) != F.col("back")).alias("n_different"))


def p9_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_mix_one_pass(spark, d):
    """The selection for mixes as large as their sources: small sources are clamped at their caps, the others take what they leave."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="pass")[0]


def p9_shares_one_pass(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="pass")[1]


def p9_checked(spark, d):
    """Both selections against the caps and the tokens allotted: no document over its cap, every source within half a document."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sizes = mixing.counted(docs)
    both = [mixing.checked(*mixing.mix(docs, targets, total=size, sizes=sizes), targets).withColumn("size", F.lit(size)) for size in ("exact", "pass")]
    return both[0].unionByName(both[1])


def p10_found(spark, d):
    return reading.demanding(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_levels(spark, d):
    docs = table(spark, d, "documents")
    return reading.levels(docs, reading.fit(docs, table(spark, d, "reading_labels")))


def p10_held_out(spark, d):
    return reading.held_out(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "p" and k[1].isdigit()}
ORACLES = {
    "p5_found": """
        WITH k AS (
            SELECT insert_seq, 'id' AS key_field, id AS v FROM observations
            UNION ALL SELECT insert_seq, 'source_event_id', source_event_id FROM observations),
        s AS (SELECT 'id' AS key_field, id AS v FROM seen_keys UNION SELECT 'source_event_id', source_event_id FROM seen_keys),
        f AS (SELECT key_field, v, min(insert_seq) AS first FROM k WHERE v IS NOT NULL GROUP BY ALL)
        SELECT k.insert_seq, k.key_field FROM k JOIN f USING (key_field, v) LEFT JOIN s USING (key_field, v)
        WHERE k.insert_seq > f.first OR s.v IS NOT NULL""",
    "p9_checked": """
        SELECT DISTINCT mix_name, source, CAST(0 AS BIGINT) AS over_cap, true AS share_met, size
        FROM mix_targets, (VALUES ('exact'), ('pass')) AS s(size) WHERE mix_name IS NOT NULL AND source IS NOT NULL""",
    "p8_round_trip": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_different FROM documents",
}
