"""Canonical JSON and content addresses as column expressions.

Canonical form: keys sorted at every level, no whitespace, array order kept,
nulls kept, numbers in their shortest round-trip form.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts whose canonical form the variant printer does not give: numbers with an
# exponent, with more digits than a double holds or tiny ones, control and surrogate escapes.
_AT = r"(?:^|[:,\[\s])-?"
_EXACT_PATH = (
    rf"{_AT}(?:[0-9.]+[eE]|[0-9.]{{16}}|0\.0{{6}})|\\u(?:00[01]|[dD][89a-fA-F])"
)


def _number(x: float) -> str:
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0)
    point -= len(whole + fraction) - len((whole + fraction).lstrip("0"))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        body = digits + "0" * (point - n)
    elif 0 < point <= 21:
        body = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * (-point) + digits
    else:
        shift = point - 1
        body = digits[0] + ("." + digits[1:] if n > 1 else "")
        body += f"e{'+' if shift > 0 else '-'}{abs(shift)}"
    return ("-" if x < 0 else "") + body




def _string(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) <= 0xDFFF else c for c in out)


def _render(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return _number(float(value))
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_render, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(_string(k) + ":" + _render(value[k]) for k in keys) + "}"


def _refuse(token: str) -> object:
    raise ValueError(token)


def _exact(text: str | None, without: str | None = None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
        if without is not None:
            value = {k: v for k, v in value.items() if k != without}
        return _render(value)
    except (ValueError, AttributeError, RecursionError, OverflowError):
        return None


@F.pandas_udf(T.StringType())
def _exact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_exact, na_action="ignore")


@F.pandas_udf(T.StringType())
def _exact_without_udf(texts: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([_exact(t, k) for t, k in zip(texts, keys)], dtype=object)


def needs_exact_text(text: Column) -> Column:
    """Texts with numbers or escapes that the variant printer does not bring into canonical form."""
    return text.rlike(_EXACT_PATH)


def needs_exact(text: Column) -> Column:
    """Texts that the variant printer alone does not bring into canonical form."""
    return needs_exact_text(text) | F.try_parse_json(text).isNull()


def canonical_json(text: Column, exact: bool = True) -> Column:
    """Canonical JSON of a JSON text; null when the text is not JSON.

    ``exact=False`` keeps the plan free of Python and is right for texts written
    by this package, whose numbers are plain integers or short decimals.
    """
    fast = F.to_json(F.try_parse_json(text))
    if not exact:
        return fast
    needs_exact = text.rlike(_EXACT_PATH) | fast.isNull()
    slow = _exact_udf(F.when(needs_exact, text))
    return F.when(needs_exact, slow).otherwise(fast)


def json_string(value: Column) -> Column:
    """A JSON string literal, or the literal null."""
    return F.coalesce(F.to_json(value.cast("variant")), F.lit("null"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash_of(text: Column, exact: bool = True) -> Column:
    return sha256(canonical_json(text, exact))


def variant_without_key(parsed: Column, key: str) -> Column:
    """JSON of a parsed object with one top-level key removed, as the variant printer gives it; null for any other value."""
    members = F.transform_values(
        F.map_filter(F.try_variant_get(parsed, "$", "map<string,variant>"), lambda k, _: k != key),
        lambda _, v: F.coalesce(F.to_json(v), F.lit("null")),
    )
    parts = F.transform(
        F.array_sort(F.map_entries(members)),
        lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), e["value"]),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def without_key(text: Column, key: str, exact: bool = True) -> Column:
    """Canonical JSON of an object text with one top-level key removed; null for any other text."""
    parsed = F.try_parse_json(text)
    fast = variant_without_key(parsed, key)
    if not exact:
        return fast
    needs_exact = text.rlike(_EXACT_PATH) | parsed.isNull()
    slow = _exact_without_udf(F.when(needs_exact, text), F.lit(key))
    return F.when(needs_exact, slow).otherwise(fast)


def content_address(text: Column, id_key: str, exact: bool = True) -> Column:
    """sha256 of a document without its own id: the record id or the link id."""
    return sha256(without_key(text, id_key, exact))


# ---- the hash body of an event --------------------------------------------------

def event_body(prev: Column | str = "prev_hash") -> tuple[Column, Column]:
    """Canonical body of an event, split around the value of ``prevHash``.

    Expects the ledger columns, with ``actor``, ``target``, ``payload`` and
    ``snapshot_ref`` already canonical.  The body is ``head || prev || tail``.
    """
    def flag(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    def doc(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("null"))

    def text(c: str) -> Column:
        return json_string(F.col(c))

    head = F.concat(
        F.lit('{"actor":'), doc("actor"),
        F.lit(',"blastRadius":'), text("blast_radius"),
        F.lit(',"effectClass":'), text("effect_class"),
        F.lit(',"id":'), text("id"),
        F.lit(',"kind":'), text("kind"),
        F.lit(',"missionId":'), text("mission_id"),
        F.lit(',"monotonicTs":'), flag("monotonic_ts"),
        F.lit(',"payload":'), doc("payload"),
        F.lit(',"prevHash":"'),
    )
    tail = F.concat(
        F.lit('","reversible":'), flag("reversible"),
        F.lit(',"seq":'), flag("seq"),
        F.lit(',"sessionId":'), text("session_id"),
        F.lit(',"signalTier":'), text("signal_tier"),
        F.lit(',"snapshotRef":'), doc("snapshot_ref"),
        F.lit(',"source":'), text("source"),
        F.lit(',"taint":'), flag("taint"),
        F.lit(',"target":'), doc("target"),
        F.lit(',"ts":'), text("ts"),
        F.lit("}"),
    )
    return head, tail


def chain_hash(prev: Column, head: Column, tail: Column) -> Column:
    return sha256(F.concat(prev, head, prev, tail))
