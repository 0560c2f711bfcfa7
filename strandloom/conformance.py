"""Checks that any store must pass to stand under the engine. Each takes a maker of empty stores and raises AssertionError.

An adapter's tests run them all: ``for name, check in CASES.items(): check(lambda: MyStores(...))``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.audit import AUDIT, GENESIS
from strandloom.sources.stores import OBSERVATIONS, AppendOnlyViolation, AuditQuery, BadQuery, ObservationQuery, RefMatch, Stores

Make = Callable[[], Stores]


def _observations(spark: SparkSession, *rows: dict) -> DataFrame:
    out = []
    for i, r in enumerate(rows):
        full = {
            "id": f"obs_{i}", "type": "Seen", "at": 10 * i, "ingested_at": 5, "actors": [("user", "ann", '{"k":1}')], "subjects": [("page", "p1", None)], "attributes": '{"a":[1,"x"]}',
            "source": ("s", None, "2"), "source_event_id": f"e{i}", "versions": ("1.0", "1.0", "1.0", "2"), "integrity": "0" * 64, "insert_seq": i,
        } | r
        out.append(tuple(full[c] for c in ("id", "type", "at", "ingested_at", "actors", "subjects", "attributes", "source", "source_event_id", "versions", "integrity", "insert_seq")))
    return spark.createDataFrame(out, OBSERVATIONS)


def _records(spark: SparkSession, *rows: tuple[int, str]) -> DataFrame:
    return spark.createDataFrame([(id_, "validation", "passed", "e", None, 1, None, s, GENESIS, "h") for s, id_ in rows], AUDIT)


def _events(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(i * 3, '{"n":%d}' % i) for i in range(n)], "arrival bigint, raw string")


def _refuses(what: Callable[[], object], kind: type[Exception]) -> None:
    try:
        what()
    except kind:
        return
    raise AssertionError(f"{kind.__name__} expected")


def _ids(df: DataFrame) -> list[str]:
    return [r["id"] for r in df.collect()]


def observations_come_back_whole(make: Make) -> None:
    s = make()
    rows = _observations(s.spark, {}, {"source": (None, None, None), "actors": [], "subjects": []})
    assert s.put(rows) == 2 and s.count() == 2 and s.query().collect() == rows.orderBy("at").collect()
    assert s.has("obs_1") and not s.has("obs_9") and _ids(s.get("obs_1")) == ["obs_1"] and _ids(s.get("none")) == []


def observations_are_append_only(make: Make) -> None:
    s = make()
    s.put(_observations(s.spark, {"attributes": "{}"}))
    _refuses(lambda: s.put(_observations(s.spark, {"attributes": '{"b":2}'})), AppendOnlyViolation)
    _refuses(lambda: s.put(_observations(s.spark, {"id": "new"}, {"id": "new"})), AppendOnlyViolation)
    assert [r["attributes"] for r in s.query().collect()] == ["{}"]


def queries_need_all_their_criteria(make: Make) -> None:
    s = make()
    s.put(_observations(s.spark, {}, {"type": "Other"}, {"actors": [("team", "ann", None), ("user", "bob", None)]}, {"subjects": []}))
    ask = lambda **q: _ids(s.query(ObservationQuery(**q)))
    assert ask(types=("Seen",)) == ["obs_0", "obs_2", "obs_3"] and ask(types=()) == []
    assert ask(from_ms=10, to_ms=30) == ["obs_1", "obs_2"]
    assert ask(actor=RefMatch("ann", "user")) == ["obs_0", "obs_1", "obs_3"] and ask(actor=RefMatch("bob", "team")) == []
    assert ask(subject=RefMatch("p1"), types=("Seen",), from_ms=1) == ["obs_2"]


def ties_keep_the_order_of_storing(make: Make) -> None:
    s = make()
    s.put(_observations(s.spark, {"at": 7}, {"at": 7}, {"at": 3}, {"at": 7}))
    assert _ids(s.query()) == ["obs_2", "obs_0", "obs_1", "obs_3"]
    assert _ids(s.query(ObservationQuery(order="desc", limit=3))) == ["obs_3", "obs_1", "obs_0"] and _ids(s.query(ObservationQuery(limit=0))) == []


def queries_are_guarded(make: Make) -> None:
    s = make()
    for bad in ({"limit": -1}, {"limit": 1.5}, {"limit": True}, {"from_ms": float("nan")}, {"to_ms": float("inf")}, {"order": "up"}):
        _refuses(lambda bad=bad: s.query(ObservationQuery(**bad)), BadQuery)
    for bad in (lambda: s.list_audit(AuditQuery(limit=-1)), lambda: s.replay(-1), lambda: s.replay(0, 2.5), lambda: s.prune_before(-1), lambda: s.prune_before(0.5), lambda: s.prune_before(None)):
        _refuses(bad, BadQuery)


def empty_stores_answer(make: Make) -> None:
    s = make()
    assert s.count() == 0 and s.query().count() == 0 and s.list_audit().count() == 0 and s.audit_tail().count() == 0
    assert s.replay().count() == 0 and s.count_archive() == 0 and s.prune_before(5) == 0


def audit_sequences_advance(make: Make) -> None:
    s = make()
    assert s.append_audit(_records(s.spark, (0, "rec-0"), (1, "rec-1"))) == 2
    for bad in (((1, "x"),), ((0, "y"),), ((5, "z"), (5, "w"))):
        _refuses(lambda bad=bad: s.append_audit(_records(s.spark, *bad)), AppendOnlyViolation)
    assert s.append_audit(_records(s.spark, (7, "rec-7"))) == 1 and _ids(s.audit_tail()) == ["rec-7"]


def audit_ids_are_unique(make: Make) -> None:
    s = make()
    s.append_audit(_records(s.spark, (0, "own"), (1, "rec-1")))
    for bad in (((2, "own"),), ((2, "rec-1"),), ((2, "new"), (3, "new"))):
        _refuses(lambda bad=bad: s.append_audit(_records(s.spark, *bad)), AppendOnlyViolation)
    s.append_audit(_records(s.spark, (2, "rec-2")))
    assert _ids(s.list_audit(AuditQuery(limit=2))) == ["own", "rec-1"] and s.list_audit(AuditQuery(stage="dedupe")).count() == 0


def archives_replay_in_order(make: Make) -> None:
    s = make()
    assert s.archive(_events(s.spark, 3), 11) == 3 and s.archive(_events(s.spark, 2), 12) == 2 and s.count_archive() == 5
    assert [(r["sequence"], r["received_at"], r["event"]) for r in s.replay(2, 2).collect()] == [(2, 11, '{"n":2}'), (3, 12, '{"n":0}')]


def archives_lose_only_their_beginning(make: Make) -> None:
    s = make()
    s.archive(_events(s.spark, 3), 1)
    s.archive(_events(s.spark, 2), 1)
    left = lambda: [r["sequence"] for r in s.replay().collect()]
    assert s.prune_before(0) == 0 and s.prune_before(2) == 2 and left() == [2, 3, 4] and s.prune_before(2) == 0
    assert s.table("archive").count() == 3 and s.prune_before(99) == 3 and left() == [] and s.count_archive() == 0
    s.archive(_events(s.spark, 1), 1)
    assert left() == [5]  # sequences are never used again


def batches_are_done_once(make: Make) -> None:
    s = make()
    assert not s.is_done("b")
    s.commit("b")
    assert s.is_done("b") and not s.is_done("c")


#: All checks by name.
CASES: dict[str, Callable[[Make], None]] = {
    f.__name__: f
    for f in (
        observations_come_back_whole, observations_are_append_only, queries_need_all_their_criteria, ties_keep_the_order_of_storing, queries_are_guarded, empty_stores_answer,
        audit_sequences_advance, audit_ids_are_unique, archives_replay_in_order, archives_lose_only_their_beginning, batches_are_done_once,
    )
}
