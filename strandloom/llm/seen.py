"""Problem 5: has this key been seen before? Ribbon filters over sealed batches, probed generation by generation.

Keys are 64-bit hashes of (field, value). Batches come in order; each is probed against the filters kept of all earlier ones
and then sealed: it leaves one ribbon filter a shard (about 14 bits a key) in the shared folder, and none of its keys is kept
in memory. A filter never misses a key it holds. Hashes of keys are even, so odd ones are certainly absent from every batch;
with these each probe counts its own wrong answers. An exact check of the few candidates removes them from the result.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.ribbon import Ribbon
from strandloom.operators.skew import HOT_SHARE
from strandloom.session import scratch, shared_files

#: Keys of one batch and shard, about: what one task holds besides the kept filters of the shard.
SHARD_KEYS = 100_000
#: Fingerprint bits: wrong answers of one filter at a rate of about 2^-12.
BITS = 12
#: Certainly absent keys probed per batch and shard by the audit.
AUDIT_KEYS = 4_000

FIELDS = ("id", "source_event_id")

_SEALED = (
    "key_field string, shard bigint, shard_bits int, gen int, known array<bigint>, known_n array<bigint>, keys bigint, "
    "filter_bits bigint, filters_probed int, audit_keys bigint, wrong_answers bigint, filter binary"
)


def key_hash(*parts: Column) -> Column:
    """An even 64-bit hash: odd numbers are nobody's key."""
    return F.shiftleft(F.xxhash64(*parts), 1)


def key_rows(rows: DataFrame, seq: Column) -> DataFrame:
    """key_field, value, seq, h of every non-null key of ``rows`` (id, source_event_id)."""
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).alias("value")) for f in FIELDS])).alias("k")
    flat = rows.select(seq.cast("bigint").alias("seq"), pair).select("k.key_field", "k.value", "seq").where(F.col("value").isNotNull())
    return flat.withColumn("h", key_hash(F.col("key_field"), F.col("value")))


class KeyFilters:
    """The sealed batches below one shared folder. Opened again, the folder goes on with the batches it holds.

    A batch is sealed by one write whose success marker appears last, so a batch that failed half-way doesn't count and is
    written again. Every batch has as many shards as its own size asks for; the coarser filters of older, smaller batches
    serve all the finer shards they cover.
    """

    def __init__(self, spark: SparkSession, root: str, bits: int = BITS):
        self.spark, self.root, self.bits = spark, root.rstrip("/"), bits
        self._files = shared_files(spark, self.root)
        self.sealed: dict[int, int] = {}  # generation -> shard bits
        for name in self._files.names("sealed"):
            if self._files.exists(f"sealed/{name}/_SUCCESS"):
                about = json.loads(self._files.read(f"about/{name}.json"))
                self.sealed[about["gen"]] = about["shard_bits"]

    def _path(self, gen: int) -> str:
        return f"{self.root}/sealed/{gen:06d}"

    def table(self, gens: list[int] | None = None) -> DataFrame:
        """What is kept of the sealed batches, one row a batch, field and shard."""
        gens = sorted(self.sealed) if gens is None else gens
        if not gens:
            return self.spark.createDataFrame([], _SEALED)
        return self.spark.read.schema(_SEALED).parquet(*[self._path(g) for g in gens])

    def take(self, gen: int, keys: DataFrame, size: int) -> DataFrame:
        """Probe the batch ``gen`` (key_field, h) of about ``size`` keys against all batches sealed before, then seal it.

        Returns h, n of the keys that occur twice in the batch or that an earlier filter claims to know; no repeat is ever
        missed. A batch that is sealed already is not taken in again: what it found is read back.
        """
        if gen not in self.sealed:
            self._seal(gen, keys, max(0, int(np.ceil(np.log2(max(1, size / (SHARD_KEYS * len(FIELDS))))))))
        return self.table([gen]).select(F.explode(F.arrays_zip("known", "known_n")).alias("k")).select(F.col("k.known").alias("h"), F.col("k.known_n").alias("n"))

    def _seal(self, gen: int, keys: DataFrame, own_bits: int) -> None:
        earlier = sorted(g for g in self.sealed if g < gen)
        fine = max([own_bits, *[self.sealed[g] for g in earlier]])
        # the highest bits of the hash name the shard
        shard = lambda b: F.shiftrightunsigned(F.col("h"), 64 - b) if b else F.lit(0).cast("bigint")
        # one row a key and task leaves the map side, so a key with a third of all rows costs nothing
        distinct = keys.groupBy("key_field", "h").agg(F.count("*").alias("n")).withColumn("shard", shard(fine))
        kept = self.table(earlier).select("key_field", "shard", "shard_bits", "gen", "filter")
        finer = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(fine) - F.col("shard_bits"))
        kept = kept.select("key_field", "gen", "filter", F.explode(F.sequence(F.col("shard") * finer, (F.col("shard") + 1) * finer - 1)).alias("shard"))
        bits, probed = self.bits, len(earlier)

        def probe(key: tuple, batch: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            field, at = str(key[0]), int(key[1])
            h, n = batch["h"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
            draw = np.random.default_rng([len(field), at & 0x7FFFFFFF, gen]).integers(-(2**62), 2**62 - 1, AUDIT_KEYS, dtype=np.int64)
            absent = draw * 2 + 1
            known, wrong = n > 1, np.zeros(len(absent), bool)
            for data in old["filter"]:
                ribbon = Ribbon.unpack(data)
                known |= ribbon.contains(h)
                wrong |= ribbon.contains(absent)
            own = Ribbon.build(h, bits)
            row = (field, at, fine, gen, h[known], n[known], own.keys, own.solution.size * 64, probed, len(absent) if probed else 0, int(wrong.sum()), own.pack())
            return pd.DataFrame([row], columns=[c.split()[0] for c in _SEALED.split(", ")]) if len(h) else pd.DataFrame(columns=[c.split()[0] for c in _SEALED.split(", ")])

        self._files.write(f"about/{gen:06d}.json", json.dumps({"gen": gen, "shard_bits": fine}))
        sealed = distinct.groupBy("key_field", "shard").cogroup(kept.groupBy("key_field", "shard")).applyInPandas(probe, _SEALED)
        sealed.write.mode("overwrite").parquet(self._path(gen))
        self.sealed[gen] = fine


def _generations(observations: DataFrame, batches: int) -> list[tuple[int, int]]:
    """``batches`` ranges of insert_seq, each from a bound up to but not including the next: scans read only their part."""
    lo, hi = observations.agg(F.min("insert_seq"), F.max("insert_seq")).first()
    if lo is None:
        return []
    bounds = [lo + (hi - lo + 1) * b // batches for b in range(batches + 1)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def sealed_in_order(filters: KeyFilters, seen: DataFrame, observations: DataFrame, batches: int) -> DataFrame:
    """h, n of all batches' candidates: ``seen`` is generation 0, then come the observations by insert_seq."""
    found = filters.take(0, key_rows(seen, F.lit(-1)), 2 * seen.count())
    rows = observations.count()
    for g, (low, high) in enumerate(_generations(observations, batches), 1):
        part = observations.where((F.col("insert_seq") >= low) & (F.col("insert_seq") < high))
        found = found.unionByName(filters.take(g, key_rows(part, F.col("insert_seq")), 2 * rows // batches))
    return found


def repeats(seen: DataFrame, observations: DataFrame, batches: int = 4, filters: KeyFilters | None = None) -> DataFrame:
    """insert_seq, key_field of every observation whose key occurs in seen or in an earlier observation.

    Nulls are never repeats; empty strings are ordinary values; rows without insert_seq have no place and are not asked
    about; empty tables give no rows. Values are compared exactly: the rows of the filters' candidates are grouped by value.
    Hot keys (fewer than 1000 can be) are settled by a broadcast of their first occurrence, so no task holds all rows of one.
    """
    spark = observations.sparkSession
    filters = filters or KeyFilters(spark, scratch(spark, "seen"))
    candidates = sealed_in_order(filters, seen, observations, batches).groupBy("h").agg(F.sum("n").alias("n"))
    placed = observations.where(F.col("insert_seq").isNotNull())
    rows = key_rows(seen, F.lit(-1)).unionByName(key_rows(placed, F.col("insert_seq")))
    limit = max(1, 2 * (seen.count() + observations.count()) // HOT_SHARE)
    hot_keys = [r["h"] for r in candidates.where(F.col("n") > limit).select("h").limit(HOT_SHARE + 1).collect()]
    mild = rows.join(candidates.select("h"), "h")
    if hot_keys:
        mild = rows.where(~F.col("h").isin(hot_keys)).join(candidates.select("h"), "h")
    first = F.min("seq").over(Window.partitionBy("h", "key_field", "value"))
    out = mild.withColumn("first", first).where(F.col("seq") > F.col("first"))
    if hot_keys:
        hot = rows.where(F.col("h").isin(hot_keys))
        firsts = hot.groupBy("h", "key_field", "value").agg(F.min("seq").alias("first"))
        out = out.unionByName(hot.join(F.broadcast(firsts), ["h", "key_field", "value"]).where(F.col("seq") > F.col("first")), allowMissingColumns=True)
    return out.select(F.col("seq").alias("insert_seq"), "key_field")


def error_rates(seen: DataFrame, observations: DataFrame, batches: int = 4) -> DataFrame:
    """key_field, gen, keys, bits_per_key, filters_probed, audit_keys, wrong_answers, wrong_rate of every batch's probe.

    wrong_rate is that of the whole question: an absent key asked against the filters of all earlier batches, where one
    wrong filter makes the answer wrong. Batch 0 has nothing before it, so its rate is NULL.
    """
    spark = observations.sparkSession
    filters = KeyFilters(spark, scratch(spark, "seen"))
    sealed_in_order(filters, seen, observations, batches)
    return filters.table().groupBy("key_field", "gen").agg(
        F.sum("keys").alias("keys"), (F.sum("filter_bits") / F.greatest(F.sum("keys"), F.lit(1))).alias("bits_per_key"), F.max("filters_probed").alias("filters_probed"),
        F.sum("audit_keys").alias("audit_keys"), F.sum("wrong_answers").alias("wrong_answers"),
        F.when(F.sum("audit_keys") > 0, F.sum("wrong_answers") / F.sum("audit_keys")).alias("wrong_rate"),
    )
