"""Envelopes for what agents do: tool calls and actions, with ids that follow from their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import canonical as C

AGENT_TOOL_CALLED_KIND = "agent.tool_called"
AGENT_ACTION_KIND = "agent.action"
CONNECTOR = "agent-events"


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _json(df: DataFrame, name: str) -> Column:
    """The column's JSON text in canonical order; NULL if it is absent or no JSON."""
    return F.to_json(F.try_parse_json(_column(df, name))) if name in df.columns else F.lit(None).cast("string")


def _envelope(df: DataFrame, kind: str, payload: Column, subjects: Column) -> DataFrame:
    q = C.quoted
    agent_id, attributes = _column(df, "agent_id"), _json(df, "agent_attributes")
    agent = F.when(agent_id.isNotNull(), C.obj(type=q(F.lit("agent")), id=q(agent_id), attributes=attributes))
    occurred = F.coalesce(_column(df, "occurred_at"), F.lit(""))
    happening = F.concat_ws("\u0000", F.lit(kind), occurred, F.coalesce(agent, F.lit("")), payload)
    event_id = F.coalesce(_column(df, "event_id"), F.concat(F.lit("agent_"), F.sha2(happening, 256)))
    # an unusable time still makes an envelope: it then fails as a timestamp
    time = F.when(occurred == "", "invalid").otherwise(occurred)
    source = C.obj(system=q(_column(df, "system")), connector=q(F.lit(CONNECTOR)))
    actors = F.concat(F.lit("["), F.coalesce(agent, F.lit("")), F.lit("]"))
    raw = C.obj(
        eventId=q(event_id), envelopeVersion=q(F.lit("1.0")), schemaVersion=q(F.lit("1.0")), kind=q(F.lit(kind)), occurredAt=q(time),
        source=source, payload=payload, actors=actors, subjects=subjects,
    )
    return df.select("arrival", raw.alias("raw"))


def tool_calls(df: DataFrame) -> DataFrame:
    """(arrival, raw) of tool calls: arrival and tool, and any of protocol, server, is_error (boolean), args and result (JSON
    texts), agent_id, agent_attributes, system, occurred_at, event_id. Equal calls at one instant get one id."""
    q = C.quoted
    is_error = _column(df, "is_error").cast("boolean").cast("string")
    payload = C.obj(tool=q(F.col("tool")), protocol=q(F.coalesce(_column(df, "protocol"), F.lit("mcp"))), server=q(_column(df, "server")), isError=is_error, args=_json(df, "args"), result=_json(df, "result"))
    subject = F.concat(F.lit("["), C.obj(type=q(F.lit("tool")), id=q(F.col("tool"))), F.lit("]"))
    return _envelope(df, AGENT_TOOL_CALLED_KIND, payload, subject)


def actions(df: DataFrame) -> DataFrame:
    """(arrival, raw) of actions: arrival and action, and any of status, detail (JSON text) and the agent's columns."""
    q = C.quoted
    payload = C.obj(action=q(F.col("action")), status=q(_column(df, "status")), detail=_json(df, "detail"))
    return _envelope(df, AGENT_ACTION_KIND, payload, F.lit("[]"))
