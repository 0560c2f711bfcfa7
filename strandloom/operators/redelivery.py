"""Problem 7: exactly one record of each identifier, over any number of intake batches.

The identifiers kept so far lie in immutable runs: sorted arrays by hash prefix. An incoming batch is reduced to its
distinct identifiers (map-side first), each prefix binary-searches its part of every run, the novel identifiers become a
new run, and runs are merged into one when there are many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import jsontext as J
from strandloom.operators.skew import join_to_unique
from strandloom.session import scratch, shared_files, written

#: Identifiers of one prefix, about: what one task holds of a run.
PREFIX_KEYS = 60_000
RUN_SCHEMA = "prefix int, hashes array<bigint>, ids array<string>, kept array<bigint>"
_OUT = RUN_SCHEMA + ", copy_ids array<string>, copy_kept array<bigint>, copy_n array<bigint>"


def search(hashes: np.ndarray, ids: np.ndarray, h: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Position of each wanted (hash, id) in a run sorted by hash, or -1. Equal hashes of different ids are walked through."""
    at = np.searchsorted(hashes, h)
    found = np.full(len(h), -1)
    open_ = np.flatnonzero(at < len(hashes))
    while len(open_):
        pos = at[open_]
        open_ = open_[hashes[pos] == h[open_]]
        pos = at[open_]
        same = ids[pos] == want[open_]
        found[open_[same]] = pos[same]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(hashes)]
    return found


def _probe(key: tuple, batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values("h", kind="stable")
    h, ids, n = batch["h"].to_numpy(), batch["id"].to_numpy(object), batch["n"].to_numpy()
    kept = batch["first"].to_numpy().copy()
    novel = np.ones(len(h), bool)
    for run in runs.itertuples(index=False):
        if len(run.hashes):
            at = search(np.asarray(run.hashes), np.asarray(run.ids, object), h, ids)
            hit = at >= 0
            kept[hit] = np.asarray(run.kept)[at[hit]]
            novel[hit] = False
    copy = ~novel | (n > 1)
    prefix = int(key[0])
    row = {"prefix": prefix, "hashes": h[novel], "ids": ids[novel], "kept": kept[novel], "copy_ids": ids[copy], "copy_kept": kept[copy], "copy_n": n[copy]}
    return pd.DataFrame([row])


def _merge(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    hashes = np.concatenate([np.asarray(x, np.int64) for x in runs["hashes"]])
    ids = np.concatenate([np.asarray(x, object) for x in runs["ids"]])
    kept = np.concatenate([np.asarray(x, np.int64) for x in runs["kept"]])
    order = np.argsort(hashes, kind="stable")
    return pd.DataFrame([{"prefix": int(key[0]), "hashes": hashes[order], "ids": ids[order], "kept": kept[order]}])


class IdentifierIndex:
    """Runs of kept identifiers below one folder of the shared file system, and the manifest of those in force.

    A folder opened again goes on with the runs its last manifest names. Batches have numbers; one that was taken in before
    gets the same answer again, read from its own run. A run is split by as many bits of the hash as its size asks for, and a
    merged run by more as it grows, so what one task holds stays bounded.
    """

    def __init__(self, spark: SparkSession, root: str, prefix_keys: int = PREFIX_KEYS, merge_at: int = 3):
        self.spark, self.root, self.prefix_keys, self.merge_at = spark, root.rstrip("/"), prefix_keys, merge_at
        self._files = shared_files(spark, self.root)
        self.state = {"version": 0, "next": 0, "runs": []}
        names = [n for n in self._files.names("manifest") if n.endswith(".json")]
        if names:
            self.state = json.loads(self._files.read(f"manifest/{names[-1]}"))

    def _bits(self, rows: int) -> int:
        return max(0, int(np.ceil(np.log2(max(1, rows / self.prefix_keys)))))

    def _commit(self, runs: list[dict], next_: int) -> None:
        state = {"version": self.state["version"] + 1, "next": next_, "runs": runs}
        if not self._files.write(f"manifest/{state['version']:09d}.json", json.dumps(state), replace=False):
            raise RuntimeError("another writer committed this version")
        self.state = state

    def table(self, runs: list[dict], bits: int) -> DataFrame:
        """The runs as rows (prefix, hashes, ids, kept), one a prefix and run, under prefixes of ``bits``.

        A run split more coarsely is cut at the finer prefixes: its arrays are sorted by hash, so each piece is a slice of it.
        """
        out = self.spark.createDataFrame([], RUN_SCHEMA)
        for coarse in sorted({r["bits"] for r in runs}):
            some = self.spark.read.schema(RUN_SCHEMA).parquet(*[r["path"] for r in runs if r["bits"] == coarse])
            out = out.unionByName(some if coarse == bits else some.mapInPandas(_cut(bits), RUN_SCHEMA))
        return out

    def ingest(self, deliveries: DataFrame, number: int | None = None) -> DataFrame:
        """Take in one batch of (id, arrival); returns id, kept, n of the identifiers that have copies to drop.

        Batches must come in order of arrival; within a batch any order will do. Null and empty ids are not identifiers.
        """
        number = self.state["next"] if number is None else number
        path = f"{self.root}/run-{number:09d}"
        if number >= self.state["next"]:
            self._take(deliveries, path, number)
        out = self.spark.read.schema(_OUT).parquet(path)
        return out.select(F.explode(F.arrays_zip("copy_ids", "copy_kept", "copy_n")).alias("c")).select(
            F.col("c.copy_ids").alias("id"), F.col("c.copy_kept").alias("kept"), F.col("c.copy_n").alias("n")
        )

    def _take(self, deliveries: DataFrame, path: str, number: int) -> None:
        known = deliveries.where(F.length("id") > 0).groupBy("id").agg(F.min("arrival").alias("first"), F.count("*").alias("n"))
        runs = self.state["runs"]
        bits = max([self._bits(deliveries.count()), *[r["bits"] for r in runs]])
        # signed order of the hash is the order of the prefixes: the run stays sorted across them
        batch = known.select("id", "first", "n", F.xxhash64("id").alias("h")).withColumn("prefix", _prefix(F.col("h"), bits))
        probed = batch.groupBy("prefix").cogroup(self.table(runs, bits).groupBy("prefix")).applyInPandas(_probe, _OUT)
        probed.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(_OUT).parquet(path).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        runs = [*runs, {"path": path, "bits": bits, "rows": rows}]
        self._commit(self._merged(runs, number) if len(runs) >= self.merge_at else runs, number + 1)

    def _merged(self, runs: list[dict], number: int) -> list[dict]:
        """All runs as one. The old runs stay on disk until the folder goes: a batch asked again reads its own."""
        path, rows = f"{self.root}/merged-{number:09d}", sum(r["rows"] for r in runs)
        bits = max([self._bits(rows), *[r["bits"] for r in runs]])
        self.table(runs, bits).groupBy("prefix").applyInPandas(_merge, RUN_SCHEMA).write.mode("overwrite").parquet(path)
        return [{"path": path, "bits": bits, "rows": rows}]


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _cut(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                hashes, ids, kept = np.asarray(row.hashes, np.int64), np.asarray(row.ids, object), np.asarray(row.kept, np.int64)
                prefix = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.diff(prefix, prepend=-1))
                pieces = [(int(prefix[a]), hashes[a:b], ids[a:b], kept[a:b]) for a, b in zip(starts, [*starts[1:], len(prefix)], strict=True)]
                if pieces:
                    yield pd.DataFrame(pieces, columns=["prefix", "hashes", "ids", "kept"])

    return run


def deliveries_of(raw_events: DataFrame) -> DataFrame:
    """arrival, id of every readable record whose top-level eventId is a non-empty JSON string (compared unescaped)."""
    J.allow_repeated_keys(raw_events.sparkSession)
    doc = J.readable(raw_events.select("arrival", "raw"), "raw", "doc")
    ids = doc.select("arrival", F.explode(F.array(J.string_field(F.col("doc"), "$.eventId"))).alias("id"))
    return ids.where(F.col("id").isNotNull() & (F.col("id") != ""))


def redelivered(raw_events: DataFrame, batches: int = 3) -> DataFrame:
    """kept_arrival, copy_arrival of every record that repeats an earlier eventId, taken in through an index in ``batches``.

    Records without a usable eventId and unreadable ones are no copies. A row given twice with the same arrival keeps one
    arrival, so it gives no pair. An identifier with a third of all rows is joined back by broadcast.
    """
    spark = raw_events.sparkSession
    total = raw_events.count()
    lo, hi = raw_events.agg(F.min("arrival"), F.max("arrival")).first()
    lo, span = (lo or 0), max(1, (hi or 0) - (lo or 0) + 1)
    gen = F.least(F.floor((F.col("arrival") - lo) * batches / F.lit(span)).cast("int"), F.lit(batches - 1))
    rows = written(deliveries_of(raw_events).withColumn("gen", gen), "deliveries")
    index = IdentifierIndex(spark, scratch(spark, "identifiers"))
    keys = [index.ingest(rows.where(F.col("gen") == g), g).withColumn("gen", F.lit(g)) for g in range(batches)]
    copies = keys[0]
    for more in keys[1:]:
        copies = copies.unionByName(more)
    tagged = lambda df: df.withColumn("k", F.concat_ws(":", F.col("gen").cast("string"), "id")).drop("gen", "id")
    pairs = join_to_unique(tagged(rows), tagged(copies), "k", "n", total)
    return pairs.where(F.col("arrival") != F.col("kept")).select(F.col("kept").alias("kept_arrival"), F.col("arrival").alias("copy_arrival"))


def exactly_once(raw_events: DataFrame, batches: int = 3) -> DataFrame:
    """The rows of ``raw_events`` without the redelivered copies."""
    return raw_events.join(redelivered(raw_events, batches).select(F.col("copy_arrival").alias("arrival")), "arrival", "left_anti")
