"""Canonical JSON, deterministic ids and integrity hashes.

Canonical text has sorted keys, no white space and shortest numbers. ``to_json`` of a VARIANT already is that for most
values; only texts with exponents, long numbers or letter escapes go through an Arrow UDF that rewrites them exactly. Texts
put together here from canonical parts and :func:`quoted` strings are canonical as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Marks that the native text may differ from the canonical one, wherever they stand.
_MAY_DIFFER = r"[0-9][eE]|[0-9][0-9.]{15}|0\.0{6}|[0-9]\.0(?![0-9])|\\u|-0(?![0-9.])"
#: The same for what is left of a text without its strings, and for the escapes within strings.
_NUMBERS = r"[0-9][eE]|[0-9][0-9.]{15}|0\.0{6}|[0-9]\.0(?![0-9])|-0(?![0-9.])"
_LETTER_ESCAPE = r"\\u00(?:0[BEF]|1[A-F])"
#: Numbers that may be beyond every double, and keys that plain objects lose.
_UNUSUAL = r"[0-9][eE]\+?[0-9]{3}|[0-9]{300}|__proto__"


def number_text(x: float) -> str:
    """The shortest text of a double that reads back as it, laid out as in canonical JSON; null for what is not finite.

    The shortest digits are padded with zeros up to 21 places before the point or 6 zeros behind it; beyond, an exponent.
    """
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    _, digits, exponent = Decimal(repr(abs(x))).normalize().as_tuple()
    text, sign = "".join(map(str, digits)), "-" if x < 0 else ""
    point = len(text) + exponent  # digits before the decimal point
    if len(text) <= point <= 21:
        return sign + text + "0" * (point - len(text))
    if 0 < point <= 21:
        return f"{sign}{text[:point]}.{text[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{text}"
    e = point - 1
    return f"{sign}{text[0]}{'.' + text[1:] if text[1:] else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value: object, endless: tuple[str, str] = ("null", "null")) -> str:
    """Canonical JSON of plain Python data. endless: what positive and negative numbers beyond all doubles become."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        x = as_double(value)
        return number_text(x) if math.isfinite(x) else endless[x < 0]
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False) if value.isprintable() else _quoted(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v, endless) for v in value) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k], endless)}" for k in keys) + "}"


def as_double(value: int | float) -> float:
    """Numbers are doubles: an integer beyond them is infinite."""
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _quoted(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) <= 0xDFFF else c for c in out)


def rewritten(text: str | None) -> str | None:
    return None if text is None else canonical(json.loads(text))


def _endless(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isfinite(as_double(value))


def json_value(value: object) -> object:
    """Plain data without what JSON can't hold: endless numbers are dropped from objects and null in arrays, and a key
    ``__proto__`` is lost. An endless number on its own stays, for whoever checks it."""
    if isinstance(value, list):
        return [None if _endless(v) else json_value(v) for v in value]
    if isinstance(value, dict):
        return {k: json_value(v) for k, v in value.items() if k != "__proto__" and not _endless(v)}
    return value


def _emptied(value: object) -> object:
    """The same with null for every endless number: what the canonical text of a ref's attributes holds."""
    if isinstance(value, list):
        return [_emptied(v) for v in value]
    if isinstance(value, dict):
        return {k: _emptied(v) for k, v in value.items()}
    return None if _endless(value) else value


def settled(raw: str | None) -> str | None:
    """The text of an event with its unusual values settled: in the fields of payload and in the attributes of refs."""
    if raw is None:
        return None
    try:
        event = json.loads(raw, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return raw
    if not isinstance(event, dict):
        return raw
    if isinstance(event.get("payload"), dict):
        event["payload"] = {k: json_value(v) for k, v in event["payload"].items()}
    for refs in (event.get("actors"), event.get("subjects")):
        for ref in refs if isinstance(refs, list) else []:
            if isinstance(ref, dict) and isinstance(ref.get("attributes"), dict):
                ref["attributes"] = _emptied(ref["attributes"])
    return canonical(event, ("1e999", "-1e999"))


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


@F.pandas_udf(StringType())
def _rewrite(texts: pd.Series) -> pd.Series:
    return texts.map(rewritten, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _rewrite_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda some: None if some is None else [rewritten(t) for t in some])


@F.pandas_udf(StringType())
def _settle(texts: pd.Series) -> pd.Series:
    return texts.map(settled, na_action="ignore")


def may_differ(text: Column) -> Column:
    """Whether a JSON text has numbers or escapes that are not canonical; hashes and words within strings don't count."""
    without_strings = F.regexp_replace(F.regexp_replace(text, r"\\\\.", ""), r'"[^"]*"', "")
    return text.rlike(_MAY_DIFFER) & (text.rlike(_LETTER_ESCAPE) | without_strings.rlike(_NUMBERS))


def exact(text: Column) -> Column:
    """The canonical form of a JSON text with sorted keys; the UDF sees only the texts that may differ."""
    return F.coalesce(_rewrite(F.when(may_differ(text), text)), text)


def exact_all(texts: Column) -> Column:
    """The same for an array of texts."""
    return F.coalesce(_rewrite_all(F.when(F.exists(texts, may_differ), texts)), texts)


def settled_text(raw: Column) -> Column:
    """:func:`settled` of the few raw texts that may need it."""
    return F.coalesce(_settle(F.when(raw.rlike(_UNUSUAL), raw)), raw)


#: What a string's characters become in JSON, the backslash first. The escapes of canonical JSON.
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), *((chr(c), {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04x}")) for c in range(32))]


def quoted(text: Column) -> Column:
    """A string as canonical JSON text; NULL stays NULL."""
    inner = F.to_json(F.array(text))
    common = F.substring(inner, F.lit(2), F.length(inner) - 2)
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in _ESCAPES])
    rare = F.concat(F.lit('"'), F.aggregate(pairs, text, lambda done, p: F.replace(done, p["c"], p["e"])), F.lit('"'))
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    # to_json writes letters of escapes in upper case
    return F.when(text.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), rare).when(text.rlike(r'["\\\x00-\x1f]'), common).when(text.isNotNull(), plain)


def member(name: str, value: Column) -> Column:
    """``"name":value`` or NULL if the value is."""
    return F.concat(F.lit(f'"{name}":'), value)


def obj(**members: Column) -> Column:
    """A JSON object of JSON texts with sorted keys; NULL members are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[member(k, members[k]) for k in sorted(members)]), F.lit("}"))


def observation_id(event_id: Column, kind: Column, version: Column) -> Column:
    text = F.concat(F.lit("["), F.concat_ws(",", quoted(event_id), quoted(kind), quoted(version)), F.lit("]"))
    return F.concat(F.lit("obs_"), F.sha2(text, 256))


def digest(text: Column, secret: str | bytes | None) -> Column:
    """SHA-256 hex of a text, or HMAC-SHA-256 under a secret (the empty one too).

    HMAC could be two nested ``sha2`` over padded keys, but then the pads, from which the secret follows, would stand in
    every plan, event log and UI. So it is an Arrow UDF that holds the secret in its closure; the key is padded once a batch.
    """
    if secret is None:
        return F.sha2(text, 256)
    key = secret.encode() if isinstance(secret, str) else bytes(secret)

    @F.pandas_udf(StringType())
    def keyed(texts: pd.Series) -> pd.Series:
        padded = hmac.new(key, digestmod=hashlib.sha256)

        def one(text: str) -> str:
            h = padded.copy()
            h.update(text.encode())
            return h.hexdigest()

        return texts.map(one, na_action="ignore")

    return keyed(text)


def refs_json(refs: Column) -> Column:
    one = lambda r: obj(attributes=r["attributes"], id=quoted(r["id"]), type=quoted(r["type"]))
    return F.concat(F.lit("["), F.array_join(F.transform(refs, one), ","), F.lit("]"))


def observation_json() -> Column:
    """The hashed content of an observation row as canonical JSON."""
    c = F.col
    source = obj(connector=quoted(c("source.connector")), system=quoted(c("source.system")), version=quoted(c("source.version")))
    versions = obj(**{k: quoted(c(f"versions.{k}")) for k in ("envelope", "schema", "normalization", "source")})
    text = obj(
        id=quoted(c("id")), type=quoted(c("type")), at=c("at").cast("string"), ingestedAt=c("ingested_at").cast("string"), actors=refs_json(c("actors")),
        subjects=refs_json(c("subjects")), attributes=c("attributes"), source=source, sourceEventId=quoted(c("source_event_id")), versions=versions,
    )
    return text


def integrity(secret: str | bytes | None = None) -> Column:
    return digest(observation_json(), secret)


def verified(secret: str | bytes | None = None) -> Column:
    """Whether a stored row's integrity is the hash of its content."""
    return F.coalesce(F.col("integrity") == integrity(secret), F.lit(False))
