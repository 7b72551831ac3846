"""The seven session facts (RF-01 ... RF-07) and their union.

Each takes typed events and returns
``session_id, fact_id, statement, confidence, ts, tie, evidence``.
Only ground-truth rows are read.  Aggregates combine before their shuffle, and
joins of one row per session onto many rows per session go through
:func:`attach`, so a session that holds a third of the ledger is split.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.commands import (
    is_completed_test_shape, is_test_shaped, verdict,
)
from ledgerlens.functions.paths import basename
from ledgerlens.functions.text import trimmed
from ledgerlens.operators.ancestry import Ancestry
from ledgerlens.operators.chain import clock_regression
from ledgerlens.operators.ordered import attach, seq_bucket
from ledgerlens.settings import settle
from ledgerlens.schemas import EVIDENCE, number_text

FACT_COLUMNS = ("session_id", "fact_id", "statement", "confidence", "ts", "tie", "evidence")


def ground_truth(events: DataFrame) -> DataFrame:
    return events.where(F.col("signal_tier") == "groundTruth")


def pointer(source: Column | str, id_: str = "id", seq: str = "seq", ts: str = "ts") -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(
        source.alias("source"), F.col(id_).alias("eventId"),
        F.col(seq).cast("bigint").alias("eventSeq"), F.col(ts).alias("ts"),
    )


def _facts(df: DataFrame, fact_id: str, statement: Column, evidence: Column,
           ts: str = "ts", tie: str = "seq") -> DataFrame:
    return df.select(
        "session_id",
        F.lit(fact_id).alias("fact_id"),
        statement.alias("statement"),
        F.lit("high").alias("confidence"),
        F.col(ts).alias("ts"),
        F.col(tie).cast("bigint").alias("tie"),
        evidence.cast(EVIDENCE).alias("evidence"),
    )


def readable_exits(events: DataFrame) -> DataFrame:
    return ground_truth(events).where(
        (F.col("kind") == "process.exit") & F.col("command").isNotNull()
    )


def in_scope_writes(events: DataFrame) -> DataFrame:
    return ground_truth(events).where((F.col("kind") == "file.write") & F.col("in_scope"))


def command_history(events: DataFrame) -> DataFrame:
    """A1: per working directory and command, the last failure and how it ended."""
    run = F.struct("seq", "id", "ts", "command", "exit_code", "exec_id", "parent_exec_id")
    outcome = verdict(F.col("exit_code"))
    return (
        readable_exits(events)
        .groupBy(
            "session_id",
            F.coalesce("cwd", F.lit("")).alias("cwd"),
            trimmed(F.col("command")).alias("key"),
        )
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.min("seq").alias("first_seq"),
            F.max_by(outcome, "seq").alias("last_verdict"),
            F.max_by(run, F.when(outcome == "fail", F.col("seq"))).alias("failed"),
        )
    )


def rf01(events: DataFrame) -> DataFrame:
    failures = settle((
        command_history(events)
        .where(F.col("failed").isNotNull())
        .select("session_id", "first_seq", "last_verdict", "failed.*")
    ), "failures")
    ancestry = Ancestry(failures.select("session_id", "seq", "exec_id", "parent_exec_id"), readable_exits(events))
    reported = failures.join(ancestry.subsumed(), ["session_id", "seq"], "left_anti")
    above = reported.where(F.col("exec_id").isNotNull()).select("session_id", F.col("exec_id").alias("node")).distinct()
    beneath = (
        ancestry.beneath(above).join(failures, ["session_id", "seq"])
        .where(F.col("exec_id").isNotNull())
        .select("session_id", "ancestor", "first_seq", pointer("process_exit").alias("below"))
        .groupBy("session_id", F.col("ancestor").alias("exec_id"))
        .agg(F.array_sort(F.collect_list(F.struct("first_seq", "below"))).alias("beneath"))
    )
    text = F.concat(
        "command", F.lit(" exited with code "), number_text(F.col("exit_code")),
        F.when(F.col("last_verdict") == "pass", ", then passed on a later run").otherwise(""),
    )
    below = F.transform(
        F.coalesce("beneath", F.array().cast(f"array<struct<first_seq:bigint,below:{EVIDENCE[6:-1]}>>")),
        lambda x: x["below"],
    )
    joined = reported.join(beneath, ["session_id", "exec_id"], "left")
    return _facts(
        joined, "RF-01", text, F.concat(F.array(pointer("process_exit")), below), tie="first_seq"
    )


def last_git_status(events: DataFrame) -> DataFrame:
    row = F.struct("id", "seq", "ts", "dirty", "dirty_known")
    return (
        ground_truth(events)
        .where(F.col("kind") == "git.status")
        .groupBy("session_id")
        .agg(F.max_by(row, "seq").alias("s"))
        .select("session_id", "s.*")
    )


def rf02(events: DataFrame) -> DataFrame:
    status = last_git_status(events).where(F.col("dirty_known") & (F.size("dirty") > 0))
    text = F.when(
        F.size("dirty") == 1, F.concat(F.lit("1 file was left uncommitted: "), F.col("dirty")[0])
    ).otherwise(F.concat(F.size("dirty").cast("string"), F.lit(" files were left uncommitted")))
    return _facts(status, "RF-02", text, F.array(pointer("git_state")))


def rf03(events: DataFrame) -> DataFrame:
    at = F.struct("seq", "id", "ts")
    is_exit = (F.col("kind") == "process.exit") & F.col("command").isNotNull()
    is_write = (F.col("kind") == "file.write") & F.col("in_scope")
    # Paths first: a session with millions of writes reaches its own row as one row per path.
    per_path = (
        ground_truth(events)
        .where(is_exit | is_write)
        .groupBy("session_id", F.when(is_write, F.col("path")).alias("path"), is_write.alias("w"))
        .agg(
            F.max_by(at, "seq").alias("last"),
            F.coalesce(F.bool_or(is_test_shaped(F.col("command"))), F.lit(False)).alias("tested"),
        )
    )
    per_session = per_path.groupBy("session_id").agg(
        F.bool_or("tested").alias("tested"),
        F.count_if("w").alias("paths"),
        F.max_by("last", F.when(F.col("w"), F.col("last.seq"))).alias("write"),
        F.max_by("last", F.when(~F.col("w"), F.col("last.seq"))).alias("exit"),
    )
    found = per_session.where(
        ~F.col("tested") & F.col("write").isNotNull() & F.col("exit").isNotNull()
    ).select("*", F.col("write.ts").alias("ts"), F.col("write.seq").alias("seq"))
    text = F.concat(
        F.col("paths").cast("string"),
        F.lit(" file(s) modified; no test command was observed in this session"),
    )
    return _facts(
        found, "RF-03", text,
        F.array(
            pointer("file_write", "write.id", "write.seq", "write.ts"),
            pointer("process_exit", "exit.id", "exit.seq", "exit.ts"),
        ),
    )


def last_completed_test(events: DataFrame) -> DataFrame:
    return (
        readable_exits(events)
        .where(F.col("exit_code").isNotNull() & is_completed_test_shape(F.col("command")))
        .groupBy("session_id")
        .agg(F.max_by(F.struct("id", "seq", "ts", "ts_ms"), "seq").alias("test"))
    )


def rf04(events: DataFrame) -> DataFrame:
    backward = clock_regression(events).select("session_id")
    tests = last_completed_test(events).join(backward, "session_id", "left_anti")
    writes = in_scope_writes(events).where(F.col("mtime_ms").isNotNull()).select(
        "session_id", "seq", "id", "ts", "path", "mtime_ms"
    )
    stale = (
        attach(writes, tests, ["session_id"], seq_bucket(), "inner")
        .where(F.col("mtime_ms") > F.col("test.ts_ms"))
        .groupBy("session_id", "path")
        .agg(F.min_by(F.struct("seq", "id", "ts", "test"), "seq").alias("w"))
        .select("session_id", "path", "w.*")
    )
    text = F.concat(basename(F.col("path")), F.lit(" modified after the last test run"))
    return _facts(
        stale, "RF-04", text,
        F.array(
            pointer("file_write"), pointer("process_exit", "test.id", "test.seq", "test.ts")
        ),
    )


def content_first_seen(events: DataFrame) -> DataFrame:
    """For each (session, path, content, bucket), where the content was first held."""
    writes = in_scope_writes(events).where(F.col("after_ref").isNotNull())
    refs = writes.select(
        "session_id", "path", "seq",
        F.explode(F.array_distinct(F.array_compact(F.array("before_ref", "after_ref")))).alias("ref"),
    )
    group = ["session_id", "path", "ref"]
    buckets = refs.groupBy(*group, seq_bucket().alias("bucket")).agg(F.min("seq").alias("seq"))
    return buckets.select(
        *group, "bucket", F.min("seq").over(Window.partitionBy(*group)).alias("first_seq")
    )


def rf05(events: DataFrame) -> DataFrame:
    writes = in_scope_writes(events).where(
        F.col("after_ref").isNotNull() & ~F.col("after_ref").eqNullSafe(F.col("before_ref"))
    ).select(
        "session_id", "path", F.col("after_ref").alias("ref"), seq_bucket().alias("bucket"),
        "seq", "id", "ts",
    )
    back = writes.join(
        content_first_seen(events), ["session_id", "path", "ref", "bucket"]
    ).where(F.col("first_seq") < F.col("seq"))
    text = F.concat(
        basename(F.col("path")), F.lit(" was changed and then reverted to earlier content")
    )
    return _facts(back, "RF-05", text, F.array(pointer("file_write")))


def rf06(events: DataFrame) -> DataFrame:
    killed = readable_exits(events).where(F.length("signal") > 0)
    text = F.concat("command", F.lit(" was terminated by "), "signal")
    return _facts(killed, "RF-06", text, F.array(pointer("process_exit")))


def rf07(events: DataFrame) -> DataFrame:
    outside = (
        ground_truth(events)
        .where(F.col("kind").isin("file.write", "file.delete") & (F.col("in_scope") == F.lit(False)))
        .groupBy("session_id", "path")
        .agg(F.min_by(F.struct("seq", "id", "ts", "kind"), "seq").alias("w"))
        .select("session_id", "path", "w.*")
    )
    text = F.concat("path", F.lit(" was modified, outside the project directory"))
    source = F.when(F.col("kind") == "file.delete", "file_delete").otherwise("file_write")
    return _facts(outside, "RF-07", text, F.array(pointer(source)))


FACTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "RF-01": rf01, "RF-02": rf02, "RF-03": rf03, "RF-04": rf04,
    "RF-05": rf05, "RF-06": rf06, "RF-07": rf07,
}


def evaluate(events: DataFrame, facts: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All facts of all sessions; ``(ts, fact_id, tie)`` is their order in a session."""
    return reduce(DataFrame.unionByName, [fn(events) for fn in (facts or FACTS).values()])


def with_ordinal(facts: DataFrame) -> DataFrame:
    """RF-ALL's ``ord``: the 0-based place of a fact in its session."""
    from ledgerlens.operators.ordered import ordered_view

    minute = F.substring("ts", 1, 16)
    placed = ordered_view(
        facts, ["session_id"], minute, ["ts", "fact_id", "tie"], position="_place"
    )
    return placed.withColumn("ord", F.col("_place") - 1).drop("_place")
