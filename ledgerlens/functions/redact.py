"""Redaction of secrets in texts, argument lists and JSON documents.

Every step counts what it is about to replace, because later patterns see the
marker that earlier ones left.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import BLANK_CHARS, DOT, EDGE, END, NOT_S, S

MARK = "[REDACTED]"

# The shapes of secrets.
URL_CREDENTIALS = (
    f"{EDGE}([a-zA-Z][a-zA-Z0-9+.-]*://)([^{BLANK_CHARS}:@/]+):([^{BLANK_CHARS}@/]+)@"
)
AUTH_SCHEME = f"(?i){EDGE}(Bearer|Basic|Token){S}+([A-Za-z0-9._~+/=-]{{8,}})"
TOKEN_SHAPES = (
    EDGE + "sk-ant-[A-Za-z0-9_-]{16,}",
    EDGE + "sk-[A-Za-z0-9_-]{20,}",
    EDGE + "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}",
    EDGE + "github_pat_[A-Za-z0-9_]{22,}",
    EDGE + "glpat-[A-Za-z0-9_-]{20,}",
    EDGE + "npm_[A-Za-z0-9]{36}" + EDGE,
    EDGE + "xox[baprse]-[A-Za-z0-9-]{10,}",
    EDGE + "AIza[A-Za-z0-9_-]{35}" + EDGE,
    EDGE + "(?:AKIA|ASIA)[0-9A-Z]{16}" + EDGE,
    EDGE + "dop_v1_[a-f0-9]{64}" + EDGE,
    EDGE + r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}",
    r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]*?-----END[A-Z ]*PRIVATE KEY-----",
)
SENSITIVE_WORDS = (
    "secret", "token", "passwd", "password", "apikey", "api_key", "access_key", "accesskey",
    "private_key", "privatekey", "credential", "authorization", "client_secret", "encryption_key",
    "signing_key", "session_key",
)
SENSITIVE_FLAGS = (
    "token", "password", "passwd", "api-key", "apikey", "secret", "client-secret", "access-token",
    "refresh-token", "private-key", "auth", "authorization", "credential",
)

# NAME=value.  A value runs to the next blank, so a run of non-blanks holds at most
# one assignment, the first; the prefix therefore must not contain an earlier one.
_NAME = "[A-Za-z_][A-Za-z0-9_]*+"
_FIRST = f"(?<!{NOT_S})((?:(?!(?<![A-Za-z0-9_-]){_NAME}={NOT_S}){NOT_S})*+)"
_SENSITIVE_NAME = (
    "(?!(?i:git_(?:author|committer)))"
    f"(?=[A-Za-z0-9_]*(?i:{'|'.join(SENSITIVE_WORDS)})[A-Za-z0-9_]*="
    "|[A-Za-z0-9_]*(?i:_auth)=|(?i:auth)=)"
)
ENV_ASSIGNMENT = (
    rf"{_FIRST}(?<![A-Za-z0-9_-]){_SENSITIVE_NAME}({_NAME})=(?!\[REDACTED\](?!{NOT_S})){NOT_S}+"
)

# (pattern, replacement with $n groups, texts of which a match holds one), as applied.
STEPS = (
    (URL_CREDENTIALS, "$1$2:" + MARK + "@", ("://",)),
    (AUTH_SCHEME, "$1 " + MARK, ()),
    *zip(TOKEN_SHAPES, [MARK] * len(TOKEN_SHAPES), (
        ("sk-ant-",), ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("glpat-",),
        ("npm_",), ("xox",), ("AIza",), ("AKIA", "ASIA"), ("dop_v1_",), ("eyJ",), ("PRIVATE KEY-----",),
    )),
    (ENV_ASSIGNMENT, "$1$2=" + MARK, ("=",)),
)
FLAG = f"(?i)^--?(?:{'|'.join(SENSITIVE_FLAGS)}){END}"
FLAG_INLINE = f"(?i)^(--?(?:{'|'.join(SENSITIVE_FLAGS)}))=({DOT}+){END}"
# What any step needs to find before it can match: one cheap pass decides who is scanned.
CANDIDATE = "(?i)://|bearer|basic|token|sk-|gh[pousr]_|github_pat_|glpat-|npm_|xox|AIza|AKIA|ASIA|dop_v1_|eyJ|PRIVATE KEY|="


def _may_match(value: Column, hints: tuple[str, ...]) -> Column:
    if not hints:
        return F.lower(value).rlike("bearer|basic|token")
    found = value.contains(hints[0])
    for hint in hints[1:]:
        found = found | value.contains(hint)
    return found


def _step(value: Column, step: tuple) -> tuple[Column, Column]:
    pattern, replacement, hints = step
    may = _may_match(value, hints)
    return (
        F.when(may, F.regexp_replace(value, pattern, replacement)).otherwise(value),
        F.when(may, F.regexp_count(value, F.lit(pattern))).otherwise(0),
    )


def with_redaction(df: DataFrame, text_col: str, value: str, count: str) -> DataFrame:
    """C3 as columns ``value`` and ``count``.

    One projection per step, so that a step reads its predecessor's text instead of
    computing it again; texts without any candidate skip every step.
    """
    source = F.col(text_col)
    out = df.withColumns({"_v": F.when(source.rlike(CANDIDATE), source), "_n": F.lit(0)})
    for step in STEPS:
        cleaned, n = _step(F.col("_v"), step)
        out = out.withColumns({"_v": cleaned, "_n": F.col("_n") + F.coalesce(n, F.lit(0))})
    return out.withColumns({
        value: F.coalesce("_v", source), count: F.col("_n").cast("bigint"),
    }).drop("_v", "_n")


def _stepper(step: tuple):
    def apply(s: Column) -> Column:
        cleaned, n = _step(s["value"], step)
        return F.struct(cleaned.alias("value"), (s["count"] + n).cast("bigint").alias("count"))

    return apply


def redact_text(text: Column) -> Column:
    """``struct<value, count>`` as one expression, for short texts inside arrays.

    The text goes through the steps as the only element of an array, so that every
    step is evaluated once although two results are read from it.
    """
    state = F.array(F.struct(text.alias("value"), F.lit(0).cast("bigint").alias("count")))
    for step in STEPS:
        state = F.transform(state, _stepper(step))
    return F.get(state, F.lit(0))


def redact_where_needed(text: Column) -> Column:
    """C3 behind the candidate test, so clean texts cost one pattern and not fifteen."""
    clean = F.struct(text.alias("value"), F.lit(0).cast("bigint").alias("count"))
    return F.when(text.rlike(CANDIDATE), redact_text(text)).otherwise(clean)


def redact_args(args: Column) -> Column:
    """C4: ``struct<value: array, count>``.  A flag consumes the next argument unless it is a flag."""
    def one(arg: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(args, i - 1))
        consumed = F.coalesce(before.rlike(FLAG), F.lit(False)) & ~arg.startswith("-")
        inline = arg.rlike(FLAG_INLINE)
        return (
            F.when(inline, F.struct(
                F.concat(F.regexp_extract(arg, FLAG_INLINE, 1), F.lit("=" + MARK)).alias("value"),
                F.lit(1).cast("bigint").alias("count"),
            ))
            .when(consumed, F.struct(
                F.lit(MARK).alias("value"), F.lit(1).cast("bigint").alias("count")
            ))
            .otherwise(redact_where_needed(arg))
        )

    each = F.transform(args, one)
    return F.struct(
        F.transform(each, lambda x: x["value"]).alias("value"),
        F.aggregate(each, F.lit(0).cast("bigint"), lambda n, x: n + x["count"]).alias("count"),
    )


def redact_command(command: Column, args: Column) -> Column:
    """``struct<command, args, full, count>`` from redacted parts."""
    c, a = redact_where_needed(command), redact_args(args)
    parts = F.concat(F.array(c["value"]), a["value"])
    return F.struct(
        c["value"].alias("command"), a["value"].alias("args"),
        F.array_join(parts, " ").alias("full"), (c["count"] + a["count"]).alias("count"),
    )


def output_tail(output: Column, limit: int | None = None) -> Column:
    """C20: captured output, or its last ``limit`` bytes, decoded with replacement characters; redact it before storing."""
    tail = output if limit is None else F.when(
        F.octet_length(output) > limit, F.substring(output, -limit, limit)
    ).otherwise(output)
    return F.make_valid_utf8(tail.cast("string"))


# ---- free JSON (C6) ------------------------------------------------------------------

_COMPILED = None


def _steps():
    global _COMPILED
    if _COMPILED is None:
        _COMPILED = [
            (re.compile(p, re.ASCII), re.sub(r"\$(\d)", r"\\\1", r)) for p, r, _ in STEPS
        ]
    return _COMPILED


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)
_LONE = re.compile("[\ud800-\udfff]")


def _quoted(value: str) -> str:
    """A JSON string; halves of surrogate pairs, which have no UTF-8, stay escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def _redact_string(value: str) -> tuple[str, int]:
    total = 0
    for pattern, replacement in _steps():
        value, n = pattern.subn(replacement, value)
        total += n
    return value, total


def _refuse(token: str):
    raise ValueError(token)


def _number(token: str) -> float:
    value = float(token)
    return value if abs(value) != float("inf") else _refuse(token)


def _is_json(text: str) -> bool:
    """Strict JSON; what is too deep for the parser counts as JSON, its strings are read one by one anyhow."""
    try:
        json.loads(text, parse_constant=_refuse, parse_float=_number)
    except ValueError:
        return False
    except RecursionError:
        return True
    return True


def _redact_document(text: str) -> tuple[str, int]:
    """The string values of a JSON text, from left to right; keys, numbers and nesting stay as they are."""
    out, total, at = [], 0, 0
    for m in _LITERAL.finditer(text):
        out.append("".join(text[at:m.start()].split()))
        at = m.end()
        value = json.loads(f'"{m[1]}"', strict=False)
        if m[2] is None:
            value, n = _redact_string(value)
            total += n
        out.append(_quoted(value) + (":" if m[2] else ""))
    out.append("".join(text[at:].split()))
    return "".join(out), total


_RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])


@F.pandas_udf(_RESULT)
def _redact_json_udf(texts: pd.Series) -> pd.DataFrame:
    values, counts = [], []
    for text in texts:
        if text is None:
            values.append(None)
            counts.append(None)
            continue
        clean, n = _redact_document(text) if _is_json(text) else _redact_string(text)
        values.append(clean if n else text)
        counts.append(n)
    return pd.DataFrame({"value": values, "count": counts})


def redact_json(text: Column) -> Column:
    """Strings of a JSON document, keys never; only documents with a candidate leave the JVM."""
    suspect = text.rlike(CANDIDATE)
    scanned = _redact_json_udf(F.when(suspect, text))
    clean = F.struct(text.alias("value"), F.lit(0).cast("bigint").alias("count"))
    return F.when(suspect, scanned).otherwise(clean)
