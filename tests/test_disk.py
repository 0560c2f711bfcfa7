"""What the intake leaves on disk, and that a chain is judged alike however its rows lie."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from strandloom.operators import audit, intake
from strandloom.operators.normalize import Clock, Options
from strandloom.session import passing, shared_root
from tests.test_intake import EVENT, frame

OPTIONS = Options(clock=Clock(1782950400000))


def _scratch(spark) -> set[Path]:
    return set(Path(shared_root(spark).removeprefix("file://"), "strandloom", spark.sparkContext.applicationId).glob("*"))


def _batch(spark, n=40):
    return frame(spark, [json.dumps(EVENT | {"eventId": f"evt-{i % (n - 5)}"}) for i in range(n)] + ["nope"])


def _new(spark, before) -> list[str]:
    return sorted(p.name.rpartition("-")[0] for p in _scratch(spark) - before)


def test_a_keyed_chain_leaves_results_and_trail(spark, monkeypatch):
    """Over several ranges of the fold; what only led to results, trail and verdict on the chain is gone."""
    monkeypatch.setattr(audit, "FOLD_ROWS", 100)
    before = _scratch(spark)
    b = intake.process(_batch(spark), Options(clock=Clock(1782950400000), audit_secret="s3")).kept()
    assert b.trail.count() == 35 * 5 + 5 * 2 + 2
    assert audit.verify_chain(b.trail, "s3").collect()[0].asDict() == {"ok": True, "length": 187, "broken_at": None, "reason": None}
    assert audit.verify_chain(b.trail).collect()[0].asDict() == {"ok": False, "length": None, "broken_at": 0, "reason": "bad_hash"}
    assert _new(spark, before) == ["results", "trail"]


def test_batches_are_stored_once(spark):
    """The trail of a batch lies in its store alone, and results that a block made go with it."""
    before = _scratch(spark)
    engine = intake.Intake(spark, OPTIONS)
    with passing(spark):
        engine.ingest(_batch(spark), "first")
    assert _new(spark, before) == ["intake"]
    assert engine.ingest(_batch(spark), "second").groupBy("status").count().orderBy("status").collect() == [("duplicate", 40), ("rejected", 1)]
    assert _new(spark, before) == ["intake", "results"] and len(engine.stores.state["audit"]) == 2
    assert audit.verify_chain(engine.stores.table("audit")).first()["length"] == 187 + 82


def _slow(rows, place):
    """The definition of verify_chain, row by row."""
    last = audit.GENESIS
    rows = sorted(rows, key=lambda r: (r[place] is not None, r[place]))
    for pos, r in enumerate(rows):
        if r["sequence"] != pos:
            return (False, None, pos, "bad_sequence")
        if r["previous_hash"] != last:
            return (False, None, pos, "broken_link")
        if not r["good"]:
            return (False, None, pos, "bad_hash")
        last = r["hash"]
    return (True, len(rows), None, None)


def test_chains_in_any_order_and_state(spark):
    trail = intake.process(_batch(spark), OPTIONS).trail
    s = F.col("sequence")
    at = lambda n, value, name="sequence": F.when(s == n, value).otherwise(F.col(name))
    changed = {
        "intact": trail, "empty": trail.where("false"), "deleted": trail.where(s != 30), "first gone": trail.where(s > 0), "twice": trail.unionByName(trail.where(s == 12)),
        "stage": trail.withColumn("stage", at(20, F.lit("x"), "stage")), "link": trail.withColumn("previous_hash", at(21, F.lit("x"), "previous_hash")), "no link": trail.withColumn("previous_hash", at(22, F.lit(None), "previous_hash")),
        "hash": trail.withColumn("hash", at(23, F.lit("x"), "hash")), "no hash": trail.withColumn("hash", at(186, F.lit(None), "hash")), "no sequence": trail.withColumn("sequence", at(9, F.lit(None))), "later": trail.withColumn("sequence", s + F.when(s > 50, 1).otherwise(0)),
        "listed": trail.withColumn("listed", F.when(s == 11, 12).when(s == 12, 11).otherwise(s)), "listed far": trail.withColumn("listed", s * 7 - 100), "listed as text": trail.withColumn("listed", F.lpad(s.cast("string"), 5, "0")),
    }
    for i, (name, t) in enumerate(changed.items()):
        place = "listed" if "listed" in t.columns else "sequence"
        rows = t.withColumn("good", F.col("hash").eqNullSafe(F.sha2(audit.record_json(F.col("previous_hash")), 256))).collect()
        lie = t.repartition(3, "hash") if i % 3 == 0 else t.coalesce(1).sortWithinPartitions("sequence")
        assert tuple(audit.verify_chain(lie, position=place).collect()[0]) == _slow(rows, place), name
