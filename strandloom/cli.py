"""Command line: take in events from a file or from standard input and say what came of them."""

from __future__ import annotations

import json
import sys

from pyspark.sql import functions as F

from strandloom.operators.intake import Intake
from strandloom.operators.normalize import Options
from strandloom.operators.payloads import EXAMPLE_SPECS
from strandloom.session import local_session
from strandloom.sources.readers import events_of_text, read_events

USAGE = "usage: python -m strandloom.cli [--audit] [--json] [--help] [FILE]\nReads a JSON array of events or NDJSON; standard input without FILE."


def line_of(r: dict) -> str:
    if r["status"] in ("accepted", "duplicate"):
        return f"{r['status']:<10} {r['type']:<16} {r['id']}"
    if r["status"] == "skipped":
        return f"skipped    unknown kind (event {r['event_id'] or '<unknown>'})"
    return f"rejected   {r['reason']:<16} {r['message']}"


def main(argv: list[str] | None = None) -> int:
    """0 if nothing was rejected, 1 if something was, 2 if the input can't be read."""
    args = sys.argv[1:] if argv is None else argv
    if "--help" in args or "-h" in args:
        print(USAGE)
        return 0
    files = [a for a in args if not a.startswith("-")]
    try:
        spark = local_session()
        events = read_events(spark, files[0]) if files else events_of_text(spark, sys.stdin.read())
        engine = Intake(spark, Options(specs=EXAMPLE_SPECS))
        results = engine.ingest(events).orderBy("arrival")
        counts = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if "--json" in args:
            out = {"results": [json.loads(x) for x in results.toJSON().toLocalIterator()], "observations": [json.loads(x) for x in engine.read.query_observations().toJSON().toLocalIterator()]}
            if "--audit" in args:
                out["audit"] = [json.loads(x) for x in engine.read.query_audit().toJSON().toLocalIterator()]
            print(json.dumps(out, indent=2))
        else:
            for r in results.toLocalIterator():
                print(line_of(r.asDict()))
            said = ", ".join(f"{counts.get(s, 0)} {s}" for s in ("accepted", "duplicate", "rejected", "skipped"))
            print(f"\n{sum(counts.values())} event(s): {said}")
            if "--audit" in args:
                print("\naudit trail:")
                for a in engine.read.query_audit().toLocalIterator():
                    print(f"  [{a['stage']}/{a['outcome']}] event={a['event_id']}" + (f" obs={a['observation_id']}" if a["observation_id"] else ""))
        return int(counts.get("rejected", 0) > 0)
    except Exception as e:
        print(str(e).split("\n")[0], file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
