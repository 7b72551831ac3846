"""Ledger schemas and the typed projection of raw events.

A payload is whatever the producer wrote, so a typed column is filled only when
the JSON value has the right class: the text "1" is not an exit code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.settings import DEFAULT_PRODUCER, Producer

RAW_EVENTS = (
    "id string, session_id string, seq bigint, ts string, monotonic_ts bigint, source string, "
    "signal_tier string, kind string, actor string, target string, effect_class string, "
    "blast_radius string, reversible boolean, taint boolean, mission_id string, payload string, "
    "snapshot_ref string, prev_hash string, hash string"
)
DRAFT_COLUMNS = (
    "id", "session_id", "ts", "monotonic_ts", "source", "signal_tier", "kind", "actor", "target",
    "effect_class", "blast_radius", "reversible", "taint", "mission_id", "payload", "snapshot_ref",
)
SESSIONS = (
    "id string, number bigint, runtime_id string, mission string, started_at string, "
    "ended_at string, exit_code bigint, cwd string"
)
EVIDENCE = "array<struct<source:string,eventId:string,eventSeq:bigint,ts:string>>"
LINKS = (
    "format string, formatVersion bigint, linkId string, author string, ts string, type string, "
    "`from` string, `to` string, reason string"
)

TYPED = (
    "id", "session_id", "seq", "ts", "ts_ms", "monotonic_ms", "source", "signal_tier", "kind",
    "command", "exit_code", "signal", "cwd", "exec_id", "parent_exec_id", "path", "in_scope",
    "mtime_ms", "bytes_before", "bytes_after", "binary", "content_withheld", "before_ref",
    "after_ref", "dirty", "dirty_known",
)


def variant_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def class_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(variant_at(v, path))


def text_at(v: Column, path: str) -> Column:
    """A JSON string, or null for any other class."""
    return F.when(class_of(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    is_number = class_of(v, path).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\b.*)$")
    return F.when(is_number, F.try_variant_get(v, path, "double"))


def flag_at(v: Column, path: str) -> Column:
    return F.when(class_of(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def array_at(v: Column, path: str) -> Column:
    """A JSON array, or null.  The cast decides: naming the class would read every member."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def texts_in(items: Column) -> Column:
    """The string members of an array of variants, in order."""
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(kept, lambda x: F.try_variant_get(x, "$", "string"))


def json_at(v: Column, path: str, keep_null: bool = False) -> Column:
    """JSON text of a member; empty values count as absent unless null is a claim."""
    text = F.to_json(variant_at(v, path))
    if keep_null:
        return F.when(class_of(v, path).isNotNull(), F.coalesce(text, F.lit("null")))
    return F.when(~text.isin('""', "null", "0", "false"), text)


def number_text(n: Column) -> Column:
    """A number as it is written in a statement: no trailing ``.0``."""
    d = n.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(ts))


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as an ISO-8601 text with three decimals, in UTC."""
    stamp = F.timestamp_millis(F.floor(ms.cast("double")).cast("bigint"))
    utc = F.to_utc_timestamp(stamp, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def project_events(raw: DataFrame) -> DataFrame:
    """Raw ledger rows to the typed columns every operator reads."""
    parsed = raw.select(
        "id", "session_id", "seq", "ts", "source", "signal_tier", "kind",
        F.col("monotonic_ts").alias("monotonic_ms"),
        F.try_parse_json("payload").alias("_p"),
        F.try_parse_json("target").alias("_t"),
        F.try_parse_json("snapshot_ref").alias("_s"),
    )
    p, t, s = F.col("_p"), F.col("_t"), F.col("_s")
    is_exit = (F.col("kind") == "process.exit") & is_object_at(p, "$")
    of_exit = lambda value: F.when(is_exit & text_at(p, "$.command").isNotNull(), value)
    dirty = F.when(F.col("kind") == "git.status", array_at(p, "$.dirtyAtEnd"))
    typed = {
        "ts_ms": epoch_ms(F.col("ts")),
        "command": of_exit(text_at(p, "$.command")),
        "exit_code": of_exit(number_at(p, "$.exitCode")),
        "signal": of_exit(non_empty(text_at(p, "$.signal"))),
        "cwd": of_exit(text_at(p, "$.cwd")),
        "exec_id": of_exit(non_empty(text_at(p, "$.execId"))),
        "parent_exec_id": of_exit(non_empty(text_at(p, "$.parentExecId"))),
        "path": text_at(t, "$.resolved"),
        "payload_path": text_at(p, "$.path"),
        "in_scope": flag_at(t, "$.inScope"),
        "mtime_ms": number_at(p, "$.mtimeMs"),
        "bytes_before": number_at(p, "$.bytesBefore").cast("bigint"),
        "bytes_after": number_at(p, "$.bytesAfter").cast("bigint"),
        "binary": flag_at(p, "$.binary"),
        "content_withheld": non_empty(text_at(p, "$.contentWithheld")),
        "before_ref": non_empty(text_at(s, "$.before")),
        "after_ref": non_empty(text_at(s, "$.after")),
        "dirty": texts_in(dirty),
        "dirty_known": dirty.isNotNull(),
    }
    kept = [c for c in parsed.columns if not c.startswith("_")]
    return parsed.select(*kept, *[v.alias(k) for k, v in typed.items()], "_p")


def payload_view(raw: DataFrame, producer: Producer = DEFAULT_PRODUCER) -> DataFrame:
    """Typed events plus the payload fields that judging and reporting read."""
    p = F.col("_p")
    return project_events(raw).withColumns({
        "spawn_command": F.when(F.col("kind") == "process.spawn", text_at(p, "$.command")),
        "sha": text_at(p, "$.sha"),
        "branch": text_at(p, "$.branch"),
        "head": text_at(p, "$.head"),
        "end_exit_code": F.when(F.col("kind") == "session.end", number_at(p, "$.exitCode")),
        "recorder": text_at(p, "$.recorder"),
        "recorder_error": F.when(F.col("kind") == "agent.output", text_at(p, "$.recorderError")),
        "identity": F.when(F.col("kind") == "session.start", F.struct(*[
            json_at(p, f"$.{k}", keep_null=k == "gitCommit").alias(k)
            for k in ("gitCommit", "machineId", "model", "runtimeVersion")
        ])),
        "interfered": F.coalesce(flag_at(p, f"$.{producer.interference_key}"), F.lit(False)),
        "refused_command": text_at(p, "$.command"),
        "refused_reason": text_at(p, "$.reason"),
        "coverage_json": F.when(
            F.col("kind") == "agent.output",
            F.to_json(variant_at(p, "$.coverageProbe.commands")),
        ),
        "coverage": F.when(
            F.col("kind") == "agent.output",
            F.transform(
                array_at(p, "$.coverageProbe.commands"),
                lambda c: F.struct(
                    text_at(c, "$.command").alias("command"),
                    text_at(c, "$.status").alias("status"),
                    text_at(c, "$.resolvedTo").alias("resolvedTo"),
                    text_at(c, "$.reason").alias("reason"),
                ),
            ),
        ),
    })
