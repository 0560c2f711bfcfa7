"""Durable stores: observations, audit records and archived raw events as append-only parquet below one folder.

Every commit is one manifest file, renamed into place; readers list only what the newest manifest names.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.audit import AUDIT
from strandloom.operators.normalize import REF
from strandloom.operators.ordering import with_running_sums
from strandloom.session import passing, shared_files
from strandloom.sources.ports import AuditStore, ObservationStore, RawEventArchive

OBSERVATIONS = (
    f"id string, type string, at bigint, ingested_at bigint, actors array<{REF}>, subjects array<{REF}>, attributes string, "
    "source struct<system:string,connector:string,version:string>, source_event_id string, "
    "versions struct<envelope:string,schema:string,normalization:string,source:string>, integrity string, insert_seq bigint"
)
ARCHIVE = "sequence bigint, received_at bigint, event string"
SCHEMAS = {"observations": OBSERVATIONS, "audit": AUDIT, "archive": ARCHIVE}


class AppendOnlyViolation(ValueError):
    """A record that is already stored, or a sequence that does not advance."""


class BadQuery(ValueError):
    """A query parameter that cannot be meant."""


def check_count(value: object, name: str) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise BadQuery(f"{name} must be a non-negative integer")


def _finite(value: object, name: str) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value)):
        raise BadQuery(f"{name} must be a finite number")


@dataclass(frozen=True)
class RefMatch:
    """A ref of this id and, if given, this type: both on the same ref."""

    id: str
    type: str | None = None

    def matches(self, ref: Column) -> Column:
        return (ref["id"] == self.id) & (F.lit(True) if self.type is None else ref["type"] == self.type)


@dataclass(frozen=True)
class ObservationQuery:
    """All given criteria must hold: from_ms is inclusive, to_ms exclusive; an empty list of types matches nothing."""

    types: tuple[str, ...] | None = None
    from_ms: float | None = None
    to_ms: float | None = None
    actor: RefMatch | None = None
    subject: RefMatch | None = None
    order: str = "asc"
    limit: int | None = None

    def check(self) -> None:
        _finite(self.from_ms, "from")
        _finite(self.to_ms, "to")
        check_count(self.limit, "limit")
        if self.order not in ("asc", "desc"):
            raise BadQuery("order must be asc or desc")


@dataclass(frozen=True)
class AuditQuery:
    event_id: str | None = None
    observation_id: str | None = None
    stage: str | None = None
    limit: int | None = None


def select_observations(df: DataFrame, q: ObservationQuery) -> DataFrame:
    """Filters reach the parquet scan; order and limit are one top-k. Ties keep the order of storing, reversed for desc."""
    q.check()
    if q.types is not None:
        df = df.where(F.col("type").isin(*q.types) if q.types else F.lit(False))
    if q.from_ms is not None:
        df = df.where(F.col("at") >= q.from_ms)
    if q.to_ms is not None:
        df = df.where(F.col("at") < q.to_ms)
    for name, m in (("actors", q.actor), ("subjects", q.subject)):
        if m is not None:
            df = df.where(F.exists(name, m.matches))
    keys = ["at", "insert_seq"]
    df = df.orderBy(*keys) if q.order == "asc" else df.orderBy(*map(F.desc, keys))
    return df if q.limit is None else df.limit(q.limit)


def select_audit(df: DataFrame, q: AuditQuery) -> DataFrame:
    check_count(q.limit, "limit")
    for c, v in (("event_id", q.event_id), ("observation_id", q.observation_id), ("stage", q.stage)):
        if v is not None:
            df = df.where(F.col(c) == v)
    df = df.orderBy("sequence")
    return df if q.limit is None else df.limit(q.limit)


#: Ids of one prefix folder of the id index, about; folders of one run at most; runs of one size that are merged into one.
PREFIX_IDS, MAX_PREFIX_BITS, MERGE_AT = 100_000, 12, 8
#: So many ids of a batch at most are sent to all tasks (about 15 MB); larger batches meet the index by a shuffled join.
BROADCAST_IDS = 200_000


class Stores(ObservationStore, AuditStore, RawEventArchive):
    """The three stores and their manifest below ``root``; opening an existing folder continues it. There is one writer.

    Parts are written first and come into force together, by one manifest renamed into place, with the name of the batch they
    came from: a failed batch leaves nothing behind. The ids stored lie in an index of their own, in runs split by hash
    prefix, of which a batch reads only the prefixes it touches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = {
            "version": 0, "commit": "", "observations": [], "ids": [], "audit": [], "archive": [], "insert_seq": 0, "audit_tail": None, "foreign_audit_ids": False,
            "archive_next": 0, "archive_floor": 0, "clock_reads": 0,
        }
        self._open()

    # ---- files and commits; a store elsewhere replaces these ----
    def _open(self) -> None:
        self._files = shared_files(self.spark, self.root)
        names = [n for n in self._files.names("manifest") if n.endswith(".json")]
        if names:
            self.state |= json.loads(self._files.read(f"manifest/{names[-1]}"))

    def _publish(self, state: dict, batch: str | None) -> None:
        if batch is not None:
            self._files.write(self._mark(batch), json.dumps({"batch": batch, "version": state["version"], "commit": state["commit"]}))
        if not self._files.write(f"manifest/{state['version']:09d}.json", json.dumps(state), replace=False):
            raise AppendOnlyViolation("another writer committed this version")

    @staticmethod
    def _mark(batch: str) -> str:
        return f"batches/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def is_done(self, batch: str) -> bool:
        """Whether this batch was committed: its mark counts only if the commit it was made for took place."""
        if not self._files.exists(self._mark(batch)):
            return False
        mark = json.loads(self._files.read(self._mark(batch)))
        manifest = f"manifest/{mark['version']:09d}.json"
        return self._files.exists(manifest) and json.loads(self._files.read(manifest))["commit"] == mark["commit"]

    def _write(self, name: str, df: DataFrame, partition_by: str | None = None) -> str:
        """Write rows of a store to a new part; they count once a commit names it."""
        part = self.new_part(name)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        with passing(self.spark):
            writer.option("compression", "zstd").parquet(f"{self.root}/{part}")
        return part

    def new_part(self, name: str) -> str | None:
        """The name below ``root`` of a part to be written; None where parts are no folders."""
        return f"{name}/part-{self.state['version']:09d}-{uuid.uuid4().hex[:8]}"

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def _forget(self, parts: list[str]) -> None:
        for p in parts:
            self._files.delete(p)

    # ---- the stores ----
    def commit(self, batch: str | None = None, **changes: object) -> None:
        """Bring changes into force, all or none; with the name of the batch they are of, if it has one."""
        state = self.state | changes | {"version": self.state["version"] + 1, "commit": uuid.uuid4().hex}
        self._publish(state, batch)
        self.state = state

    def table(self, name: str) -> DataFrame:
        parts = self.state[name]
        return self._read([p["path"] if isinstance(p, dict) else p for p in parts], SCHEMAS[name])

    def known_among(self, ids: DataFrame) -> DataFrame:
        """Those of the distinct ``ids`` (column id) that are stored. Of each run of the index only the prefixes touched are read."""
        runs = self.state["ids"]
        if not runs:
            return ids.where(F.lit(False))
        out = None
        for bits in sorted({r["bits"] for r in runs}):
            kept = self._runs([r for r in runs if r["bits"] == bits])
            if bits:
                touched = [r[0] for r in ids.select(_prefix(bits)).distinct().collect()]  # 2 ** MAX_PREFIX_BITS at most
                kept = kept.where(F.col("prefix").isin(touched)) if len(touched) < 2**bits else kept
            out = kept.select("id") if out is None else out.unionByName(kept.select("id"))
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return out.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def _indexed(self, ids: DataFrame, n: int) -> list[dict]:
        """The id index with one more run; MERGE_AT runs of about one size become one."""
        runs = [*self.state["ids"], self._run(ids, n)]
        size = lambda r: int(math.log(max(1, r["rows"]), MERGE_AT))
        while len(some := [r for r in runs if size(r) == size(runs[-1])]) >= MERGE_AT:
            merged = self._run(self._runs(some).select("id"), sum(r["rows"] for r in some))
            runs = [*[r for r in runs if r not in some], merged]
        return runs

    def _runs(self, runs: list[dict]) -> DataFrame:
        """id, prefix of some runs; each is a folder tree of its own, so each is read for itself."""
        parts = [self._read([r["path"]], "id string, prefix int") for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _run(self, ids: DataFrame, n: int) -> dict:
        bits = max(0, min(MAX_PREFIX_BITS, math.ceil(math.log2(max(1, n / PREFIX_IDS)))))
        rows = ids.select("id", _prefix(bits).alias("prefix")).repartition(max(1, 2**bits), "prefix") if bits else ids.select("id", F.lit(0).alias("prefix")).coalesce(1)
        return {"path": self._write("ids", rows, "prefix" if bits else None), "rows": n, "bits": bits}

    def observations_put(self, rows: DataFrame, checked: bool = False) -> dict:
        """The changes that append observations (with insert_seq). checked: their ids are known to be distinct and new."""
        if not checked:
            twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
            clash = twice.unionByName(self.known_among(rows.select("id").distinct())).limit(1).collect()
            if clash:
                raise AppendOnlyViolation(f"append-only violation: observation {clash[0]['id']} already stored")
        part = self._write("observations", rows)
        kept = self._read([part], OBSERVATIONS)
        n = kept.count()
        return {"observations": [*self.state["observations"], part], "insert_seq": self.state["insert_seq"] + n, "ids": self._indexed(kept, n) if n else self.state["ids"]}

    def put(self, rows: DataFrame) -> int:
        changes = self.observations_put(rows)
        n = changes["insert_seq"] - self.state["insert_seq"]
        self.commit(**changes)
        return n

    def audit_appended(self, records: DataFrame, part: str | None = None) -> dict:
        """The changes that append chained records. Ids the engine made follow from their sequence, so only others are looked up.
        part: the new part that the records were written to already."""
        part = part or self._write("audit", records)
        kept = self._read([part], AUDIT)
        foreign = F.col("id") != F.concat(F.lit("rec-"), F.col("sequence").cast("string"))
        with passing(self.spark):
            n, low, distinct, ids, other, last = kept.agg(
                F.count("*"), F.min("sequence"), F.count_distinct("sequence"), F.count_distinct(F.when(foreign, F.col("id"))), F.count_if(foreign), F.max(F.struct("sequence", "hash"))
            ).first()
        before = self.state["audit_tail"]
        if n and (distinct != n or (before is not None and low <= before["sequence"])):
            raise AppendOnlyViolation("append-only violation: audit sequence must advance")
        again = other or self.state["foreign_audit_ids"]
        if ids != other or (again and self._audit_clash(kept)):
            raise AppendOnlyViolation("append-only violation: audit id already stored")
        if not n:
            return {}
        return {"audit": [*self.state["audit"], part], "audit_tail": {"sequence": last["sequence"], "hash": last["hash"]}, "foreign_audit_ids": bool(again)}

    def _audit_clash(self, kept: DataFrame) -> bool:
        twice = kept.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        return not twice.unionByName(kept.select("id").join(self.table("audit").select("id"), "id", "left_semi")).isEmpty()

    def append_audit(self, records: DataFrame) -> int:
        changes = self.audit_appended(records)
        if not changes:
            return 0
        self.commit(**changes)
        return self._read([changes["audit"][-1]], AUDIT).count()

    def archived(self, events: DataFrame) -> dict:
        """The changes that append raw texts (arrival, raw, received_at) in order of arrival."""
        n, next_ = events.count(), self.state["archive_next"]
        if not n:
            return {}
        place = with_running_sums(events.select("arrival"), "arrival", {"place": 1}, n)
        rows = events.select("arrival", F.coalesce("raw", F.lit("null")).alias("event"), "received_at").join(place, "arrival")
        part = self._write("archive", rows.select((F.col("place") + next_).alias("sequence"), "received_at", "event"))
        return {"archive": [*self.state["archive"], {"path": part, "from": next_, "to": next_ + n}], "archive_next": next_ + n}

    def archive(self, events: DataFrame, received_at: int) -> int:
        changes = self.archived(events.select("arrival", "raw", F.lit(received_at).cast("bigint").alias("received_at")))
        self.commit(**changes)
        return changes["archive"][-1]["to"] - changes["archive"][-1]["from"] if changes else 0

    def replay(self, from_sequence: int | None = None, limit: int | None = None) -> DataFrame:
        check_count(from_sequence, "fromSequence")
        check_count(limit, "limit")
        low = max(from_sequence or 0, self.state["archive_floor"])
        paths = [p["path"] for p in self.state["archive"] if p["to"] > low]
        df = self._read(paths, ARCHIVE).where(F.col("sequence") >= low).orderBy("sequence")
        return df if limit is None else df.limit(limit)

    def count_archive(self) -> int:
        return sum(p["to"] - max(p["from"], self.state["archive_floor"]) for p in self.state["archive"])

    def prune_before(self, sequence: int) -> int:
        """Delete the archive's prefix below ``sequence``; the count of deleted events. Parts that lie wholly below it leave
        the disk, one that lies partly below is written anew without its beginning. Sequences are never used again."""
        if sequence is None:
            raise BadQuery("sequence must be a non-negative integer")
        check_count(sequence, "sequence")
        gone = sum(max(0, min(p["to"], sequence) - p["from"]) for p in self.state["archive"])
        if not gone:
            return 0
        kept, old = [], []
        for p in self.state["archive"]:
            if p["from"] >= sequence:
                kept.append(p)
                continue
            old.append(p["path"])
            if p["to"] > sequence:
                kept.append({"path": self._write("archive", self._read([p["path"]], ARCHIVE).where(F.col("sequence") >= sequence)), "from": sequence, "to": p["to"]})
        self.commit(archive=kept, archive_floor=max(min(sequence, self.state["archive_next"]), self.state["archive_floor"]))
        self._forget(old)
        return gone

    def get(self, id: str) -> DataFrame:
        return self.table("observations").where(F.col("id") == id)

    def has(self, id: str) -> bool:
        return not self.known_among(self.spark.createDataFrame([(id,)], "id string")).isEmpty()

    def query(self, q: ObservationQuery | None = None) -> DataFrame:
        return select_observations(self.table("observations"), q or ObservationQuery())

    def count(self) -> int:
        return self.table("observations").count()

    def list_audit(self, q: AuditQuery | None = None) -> DataFrame:
        return select_audit(self.table("audit"), q or AuditQuery())

    def audit_tail(self) -> DataFrame:
        return self.table("audit").orderBy(F.desc("sequence")).limit(1)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).cast("int")


class MemoryStores(Stores):
    """The same stores without files, for tests and short-lived engines: parts are persisted frames and go with the session."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "memory:")

    def _open(self) -> None:
        self._parts: dict[str, DataFrame] = {}
        self._done: set[str] = set()

    def _publish(self, state: dict, batch: str | None) -> None:
        if batch is not None:
            self._done.add(batch)

    def is_done(self, batch: str) -> bool:
        return batch in self._done

    def new_part(self, name: str) -> None:
        return None

    def _write(self, name: str, df: DataFrame, partition_by: str | None = None) -> str:
        part = f"{name}-{len(self._parts)}"
        self._parts[part] = df.persist()
        return part

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for p in parts:
            out = out.unionByName(self._parts[p].select(*out.columns))
        return out

    def _forget(self, parts: list[str]) -> None:
        for p in parts:
            self._parts[p].unpersist()


class ReadApi:
    """The read side over a store."""

    def __init__(self, stores: Stores, observation_types: list[str]):
        self._stores, self._types = stores, observation_types

    def get_observation(self, id: str) -> DataFrame:
        return self._stores.get(id)

    def has_observation(self, id: str) -> bool:
        return self._stores.has(id)

    def query_observations(self, q: ObservationQuery | None = None) -> DataFrame:
        return self._stores.query(q)

    def count_observations(self) -> int:
        return self._stores.count()

    def observation_types(self) -> list[str]:
        return list(self._types)

    def event_audit(self, event_id: str) -> DataFrame:
        return self.query_audit(AuditQuery(event_id=event_id))

    def query_audit(self, q: AuditQuery | None = None) -> DataFrame:
        return self._stores.list_audit(q)


def ref_bridge(observations: DataFrame) -> DataFrame:
    """observation_id, role, ref_type, ref_id: one row a ref, for joins on refs."""
    parts = [observations.select(F.col("id").alias("observation_id"), F.lit(role).alias("role"), F.explode(name).alias("r")) for role, name in (("actor", "actors"), ("subject", "subjects"))]
    return parts[0].unionByName(parts[1]).select("observation_id", "role", F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id"))
