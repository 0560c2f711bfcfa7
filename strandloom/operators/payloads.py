"""Payload specifications, compiled to column expressions, and the bundled ones."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import jsontext as J
from strandloom.functions.canonical import canonical, json_value, member


@dataclass(frozen=True)
class Check:
    """One payload field: name, kind of check, whether it may be absent, and the values of an enumeration."""

    name: str
    kind: str
    optional: bool = False
    values: tuple[str, ...] = ()

    def _value(self, payload: Column) -> Column:
        return F.try_variant_get(payload, f"$.{self.name}", "variant")

    def message(self, payload: Column) -> Column:
        """What is wrong with the field, NULL if nothing. An explicit null is present, so it fails all typed checks."""
        v = self._value(payload)
        number = F.try_variant_get(payload, f"$.{self.name}", "double")
        finite = F.schema_of_variant(v).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & ~F.isnan(number) & (F.abs(number) < float("inf"))
        text = F.try_variant_get(payload, f"$.{self.name}", "string")
        wrong = {
            "string": lambda: F.when(~J.is_string(v) | (text == ""), "must be a non-empty string"),
            "number": lambda: F.when(~finite, "must be a finite number"),
            "integer": lambda: F.when(~finite, "must be a finite number").when(number != F.floor(number), "must be an integer"),
            "boolean": lambda: F.when(F.schema_of_variant(v) != "BOOLEAN", "must be a boolean"),
            "enum": lambda: F.when(~J.is_string(v) | ~text.isin(*self.values), "must be one of: " + ", ".join(self.values)),
            "json": lambda: F.when(F.isnan(number) | (F.abs(number) == float("inf")), "must be a JSON value"),
        }[self.kind]()
        absent = F.lit(None).cast("string") if self.optional else F.lit("is required")
        return F.when(v.isNull(), absent).otherwise(wrong)

    def text(self, payload: Column) -> Column:
        return member(self.name, F.to_json(self._value(payload)))


#: What a validator in Python returns: attributes as plain data, or the issues found as (path below payload, message).
Validation = dict | list
_VALIDATED = "attributes string, issues array<struct<path:string,message:string>>"
_ISSUES = "array<struct<path:string,message:string>>"


@dataclass(frozen=True)
class PayloadSpec:
    """The schema of one (kind, schema version): the observation type and the checks in the order issues are reported.

    computed: attributes that are not read but made, as (name, function of the payload's VARIANT to a JSON text or NULL).
    validator: instead of checks, a Python function of the payload (plain data) that returns a dict of attributes or a list of
    issues (path, message); it runs in Arrow batches over the payloads of this kind alone.
    """

    kind: str
    schema_version: str
    type: str
    checks: tuple[Check, ...] = ()
    computed: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    validator: Callable[[object], Validation] | None = None

    def _validated(self, payload: Column, here: Column) -> Column:
        validate = self.validator

        @F.pandas_udf(_VALIDATED)
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for text in texts:
                got = [] if text is None else validate(json.loads(text))
                issues = [{"path": f"payload.{p}" if p else "payload", "message": m} for p, m in got] if isinstance(got, list) else []
                rows.append((canonical(json_value(got)) if isinstance(got, dict) else None, issues))
            return pd.DataFrame(rows, columns=["attributes", "issues"])

        return run(F.when(here, F.to_json(payload)))

    def issues(self, payload: Column, here: Column) -> Column:
        """array<struct<path,message>> of a payload that is there; a payload that is no object has one issue."""
        if self.validator is not None:
            return self._validated(payload, here)["issues"]
        messages = [c.message(payload) for c in self.checks]
        fine = J.is_object(payload)
        for m in messages:
            fine = fine & m.isNull()
        found = F.filter(
            F.array(*[F.struct(F.lit(f"payload.{c.name}").alias("path"), m.alias("message")) for c, m in zip(self.checks, messages, strict=True)]).cast(_ISSUES),
            lambda x: x["message"].isNotNull(),
        )
        whole = F.array(F.struct(F.lit("payload").alias("path"), F.lit("must be an object").alias("message"))).cast(_ISSUES)
        return F.when(fine, F.array().cast(_ISSUES)).when(J.is_object(payload), found).otherwise(whole)

    def attributes(self, payload: Column, here: Column) -> Column:
        """JSON of the declared fields that are there and of the computed ones, keys sorted."""
        if self.validator is not None:
            return self._validated(payload, here)["attributes"]
        members = {c.name: c.text(payload) for c in self.checks} | {name: member(name, make(payload)) for name, make in self.computed}
        return F.concat(F.lit("{"), F.concat_ws(",", *[members[k] for k in sorted(members, key=lambda k: k.encode("utf-16-be"))]), F.lit("}"))


class Registry:
    """The specs in force. Two of the same (kind, schema version) are an error."""

    def __init__(self, specs: tuple[PayloadSpec, ...] | list[PayloadSpec]):
        self.specs: dict[str, dict[str, PayloadSpec]] = {}
        for s in specs:
            known = self.specs.setdefault(s.kind, {})
            if s.schema_version in known:
                raise ValueError(f"duplicate spec for kind {s.kind!r}, schemaVersion {s.schema_version!r}")
            known[s.schema_version] = s

    def observation_types(self) -> list[str]:
        return sorted({s.type for k in self.specs.values() for s in k.values()}, key=lambda t: t.encode("utf-16-be"))

    def known_kind(self, kind: Column) -> Column:
        return kind.isin(*self.specs) if self.specs else F.lit(False)

    def versions_text(self, kind: Column) -> Column:
        out = F.lit("")
        for k, v in self.specs.items():
            out = F.when(kind == k, ", ".join(v)).otherwise(out)
        return out

    def pick(self, kind: Column, version: Column, value: Callable[[PayloadSpec, Column], Column], none: Column) -> Column:
        """``value`` (of the spec and of whether it is the row's) for the spec that kind and version name; only that branch is evaluated."""
        out = None
        for by_version in self.specs.values():
            for s in by_version.values():
                here = (kind == s.kind) & (version == s.schema_version)
                out = F.when(here, value(s, here)) if out is None else out.when(here, value(s, here))
        return none if out is None else out.otherwise(none)


#: The bundled payload schemas.
REVIEW_SUBMITTED = PayloadSpec("review.submitted", "1.0", "ReviewSubmitted", (Check("pullRequest", "string"), Check("decision", "enum", values=("approved", "changes_requested", "commented")), Check("comments", "integer", True)))
DEPLOY_FINISHED = PayloadSpec("deploy.finished", "1.0", "DeployFinished", (Check("service", "string"), Check("environment", "string"), Check("status", "enum", values=("succeeded", "failed")), Check("durationMs", "integer", True)))
ISSUE_OPENED = PayloadSpec("issue.opened", "1.0", "IssueOpened", (Check("issue", "string"), Check("title", "string"), Check("priority", "enum", True, ("low", "medium", "high"))))
AGENT_TOOL_CALLED = PayloadSpec("agent.tool_called", "1.0", "AgentToolCalled", (Check("tool", "string"), Check("protocol", "string", True), Check("server", "string", True), Check("isError", "boolean", True), Check("args", "json", True), Check("result", "json", True)))
AGENT_ACTION = PayloadSpec("agent.action", "1.0", "AgentAction", (Check("action", "string"), Check("status", "enum", True, ("ok", "error", "pending")), Check("detail", "json", True)))

EXAMPLE_SPECS = (REVIEW_SUBMITTED, DEPLOY_FINISHED, ISSUE_OPENED)
AGENT_SPECS = (AGENT_TOOL_CALLED, AGENT_ACTION)
