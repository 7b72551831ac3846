"""What a session's ledger cannot tell: limitations, degradations, integrity.

Notes are rows ``(session_id, rank, seq, text)`` in reading order, so a session
with very many recorder errors is never gathered into one value here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.commands import is_completed_test_shape, is_test_shaped
from ledgerlens.operators.chain import clock_regression
from ledgerlens.operators.facts import ground_truth
from ledgerlens.settings import DEFAULT_PRODUCER, Producer


def _ordered_texts(rows: DataFrame, topic: str, name: str) -> Column:
    picked = F.when(F.col("topic") == topic, F.struct("seq", "text"))
    listed = F.array_sort(F.collect_list(picked))
    return F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias(name)


def mentioned(view: DataFrame) -> DataFrame:
    """Distinct commands and reasons that a note names, in order of first appearance."""
    gt = ground_truth(view)
    is_exit = (F.col("kind") == "process.exit") & F.col("command").isNotNull()
    completed = is_completed_test_shape(F.col("command"))
    topics = F.array_compact(F.array(
        F.when(is_exit & is_test_shaped(F.col("command")) & ~completed,
               F.struct(F.lit("watch").alias("topic"), F.col("command").alias("text"))),
        F.when(is_exit & completed & F.col("exit_code").isNull(),
               F.struct(F.lit("unfinished").alias("topic"), F.col("command").alias("text"))),
        F.when((F.col("kind") == "file.write") & F.col("content_withheld").isNotNull(),
               F.struct(F.lit("withheld").alias("topic"), F.col("content_withheld").alias("text"))),
    ))
    first = (
        gt.select("session_id", "seq", F.explode(topics).alias("t"))
        .groupBy("session_id", "t.topic", "t.text")
        .agg(F.min("seq").alias("seq"))
    )
    return first.groupBy("session_id").agg(
        _ordered_texts(first, "watch", "watch_commands"),
        _ordered_texts(first, "unfinished", "unfinished_commands"),
        _ordered_texts(first, "withheld", "withheld_reasons"),
    )


def session_flags(view: DataFrame) -> DataFrame:
    """One row of conditional counts per session, over ``payload_view`` columns."""
    gt = ground_truth(view)
    kind = F.col("kind")
    is_exit = (kind == "process.exit") & F.col("command").isNotNull()
    is_write = kind == "file.write"
    scoped = is_write & F.coalesce("in_scope", F.lit(False))
    shaped = is_exit & is_test_shaped(F.col("command"))
    run = is_exit & is_completed_test_shape(F.col("command"))
    status_seq = F.when(kind == "git.status", F.col("seq"))
    flags = gt.groupBy("session_id").agg(
        F.count_if(is_exit).alias("exits"),
        F.bool_or(scoped).alias("wrote"),
        F.count_if(shaped).alias("test_shaped"),
        F.count_if(run).alias("test_runs"),
        F.count_if(run & F.col("exit_code").isNotNull()).alias("completed_runs"),
        F.coalesce(F.bool_or(scoped & F.col("mtime_ms").isNull()), F.lit(False)).alias("unknown_mtime"),
        F.count_if((kind == "process.exit") & F.col("command").isNull()).alias("malformed"),
        F.max_by("dirty_known", status_seq).alias("dirty_known"),
        F.bool_or(kind == "session.end").alias("closed"),
        F.min_by("coverage", F.when(F.col("coverage").isNotNull(), F.col("seq"))).alias("coverage"),
        F.count_if(is_write & F.col("content_withheld").isNotNull()).alias("withheld"),
        F.count_if(F.col("recorder_error").isNotNull()).alias("recorder_errors"),
    )
    return flags.join(mentioned(view), "session_id", "left").join(
        clock_regression(view), "session_id", "left"
    )


def _explode_notes(df: DataFrame, notes: list[Column]) -> DataFrame:
    ranked = F.array_compact(F.array(*[
        F.when(n.isNotNull(), F.struct(F.lit(i).alias("rank"), n.alias("text")))
        for i, n in enumerate(notes)
    ]))
    return df.select(
        "session_id", F.explode(ranked).alias("n")
    ).select("session_id", "n.rank", F.lit(0).cast("bigint").alias("seq"), "n.text")


def limitations(view: DataFrame, producer: Producer = DEFAULT_PRODUCER, flags: DataFrame | None = None) -> DataFrame:
    """The eight things a session's facts could not settle, in fixed order."""
    f = flags if flags is not None else session_flags(view)
    watch_runs = F.col("test_shaped") - F.col("test_runs")
    unfinished = F.col("test_runs") - F.col("completed_runs")
    seconds = F.format_string("%.1f", -F.col("drift_ms") / F.lit(1000.0))
    return _explode_notes(f, [
        F.when(
            (F.col("exits") == 0) & F.col("wrote"),
            "No commands were observed in this session, so nothing can be said about whether "
            "tests ran. Files did change. Check the coverage report — a shadowed shim records "
            "nothing, and that silence is not evidence.",
        ).when(
            (F.col("exits") > 0) & (F.col("test_shaped") == 0),
            "No test command was recognised in this session. If tests did run, "
            f"{producer.label} did not recognise the command — RF-03 and RF-04 are therefore "
            "not evidence that testing was skipped.",
        ),
        F.when((watch_runs > 0) & (F.col("completed_runs") == 0), F.concat(
            F.lit("A watch-mode test command was observed: "), "watch_commands",
            F.lit(". A watcher runs continuously and does not terminate with a verdict, so a test "
                  "command WAS observed but no completed test run was. This is not evidence that "
                  "testing was skipped, and not evidence that the tests passed."),
        )),
        F.when(F.col("at_seq").isNotNull(), F.concat(
            F.lit("The wall clock moved backward during this session — event #"),
            F.col("at_seq").cast("string"), F.lit(" is "), seconds,
            F.lit("s earlier than the monotonic clock allows. RF-04 orders file writes against "
                  "test runs by wall-derived times, so it was not evaluated; treat any "
                  "timestamp-based ordering in this record as unreliable."),
        )),
        F.when((unfinished > 0) & (F.col("completed_runs") == 0), F.concat(
            F.lit("A test command was observed but produced no exit code, so it reached no verdict: "),
            "unfinished_commands",
            F.lit(f". {producer.label} cannot say whether the tests passed, failed, or ran at all "
                  "— and this is not evidence that testing was skipped."),
        )),
        F.when(
            F.col("unknown_mtime"),
            "Some file writes have no modification time, so RF-04 could not determine whether "
            "they happened before or after the last test run. They are excluded, not assumed.",
        ),
        F.when(F.col("malformed") > 0, F.concat(
            F.col("malformed").cast("string"),
            F.lit(" command event(s) could not be read — the payload is missing or malformed. "
                  "They are excluded from every fact, so anything those commands did is unknown "
                  "rather than absent."),
        )),
        F.when(
            F.col("dirty_known") == F.lit(False),
            "Git working-tree state was recorded but could not be read, so RF-02 could not "
            "determine whether anything was left uncommitted. This is not a clean tree.",
        ),
    ])


def recorder_errors(view: DataFrame) -> DataFrame:
    """Recorder failures as the ledger states them."""
    return ground_truth(view).where(F.col("recorder_error").isNotNull()).select(
        "session_id", F.lit(0).alias("rank"), F.col("seq").cast("bigint").alias("seq"),
        F.concat(F.coalesce("recorder", F.lit("recorder")), F.lit(": "), "recorder_error").alias("text"),
    )


def interference(view: DataFrame, producer: Producer = DEFAULT_PRODUCER) -> DataFrame:
    """Commands that the recorder itself refused to run."""
    shown = lambda c: F.coalesce(c, F.lit("undefined"))
    return ground_truth(view).where(
        (F.col("kind") == "agent.output") & F.col("interfered")
    ).select(
        "session_id", F.lit(0).alias("rank"), F.col("seq").cast("bigint").alias("seq"),
        F.concat(
            F.lit(f"{producer.label} refused to run '"), shown("refused_command"), F.lit("' ("),
            shown("refused_reason"),
            F.lit("). A parent command failing because of this is not the agent's failure."),
        ).alias("text"),
    )


def _with_status(coverage: Column, status: str) -> Column:
    kept = F.filter(coverage, lambda c: c["status"] == status)
    return F.array_join(F.transform(kept, lambda c: c["command"]), ", ")


def degradations(view: DataFrame, producer: Producer = DEFAULT_PRODUCER, flags: DataFrame | None = None) -> DataFrame:
    """Why a record is not complete evidence, in fixed order."""
    f = flags if flags is not None else session_flags(view)
    probed = F.coalesce("coverage", F.array().cast(
        "array<struct<command:string,status:string,resolvedTo:string,reason:string>>"
    ))
    shadowed, unknown = _with_status(probed, "shadowed"), _with_status(probed, "unknown")
    has = lambda status: F.exists(probed, lambda c: c["status"] == status)
    none = F.lit(None).cast("string")
    fixed = _explode_notes(f, [
        F.when(
            ~F.col("closed"),
            "This session has no end event. It is still running, or the wrapper died before it "
            "could close the record — anything after the last event was not observed.",
        ),
        F.when(has("shadowed"), F.concat(
            F.lit("Shims were shadowed on PATH for: "), shadowed,
            F.lit(f". If the agent ran these, {producer.label} did not see it, and their absence "
                  "from this report proves nothing."),
        )),
        F.when(has("unknown"), F.concat(
            F.lit("Coverage could not be measured for: "), unknown,
            F.lit(f". This is a statement about {producer.label}, not about whether those "
                  "commands ran."),
        )),
        F.when(
            F.size(probed) == 0,
            "Command coverage was never probed for this session, so there is no measurement of "
            f"which commands {producer.label} could observe.",
        ),
        none,
        F.when(F.col("withheld") > 0, F.concat(
            F.col("withheld").cast("string"),
            F.lit(" file change(s) were recorded without content ("), "withheld_reasons",
            F.lit("). The change is in the record; the bytes are not, so content-based facts "
                  "could not be computed for them."),
        )),
    ])
    failed = recorder_errors(view).select(
        "session_id", F.lit(4).alias("rank"), "seq",
        F.concat(
            F.lit("A recorder failed during this session — "), "text",
            F.lit(". Its events are missing."),
        ).alias("text"),
    )
    return fixed.unionByName(failed)


def integrity(degraded: DataFrame, chains: DataFrame) -> DataFrame:
    """BROKEN, DEGRADED or VERIFIED per session of ``chains`` (from verify_chain)."""
    gaps = degraded.groupBy("session_id").agg(F.count(F.lit(1)).alias("gaps"))
    joined = chains.join(gaps, "session_id", "left")
    n = F.coalesce("gaps", F.lit(0))
    return joined.withColumn("gaps", n).withColumn(
        "status",
        F.when(~F.col("intact"), "BROKEN").when(n > 0, "DEGRADED").otherwise("VERIFIED"),
    )


def command_coverage(view: DataFrame) -> DataFrame:
    """The first coverage probe of each session, by status."""
    first = ground_truth(view).groupBy("session_id").agg(
        F.min_by("coverage", F.when(F.col("coverage").isNotNull(), F.col("seq"))).alias("coverage")
    )
    return (
        first.select("session_id", F.posexplode("coverage").alias("pos", "c"))
        .groupBy("session_id", F.col("c.status").alias("status"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "c.command"))).alias("listed"))
        .select(
            "session_id", "status",
            F.transform("listed", lambda x: x["command"]).alias("commands"),
        )
    )


def gather(notes: DataFrame, name: str) -> DataFrame:
    """Notes of a session as one ordered array, for documents that embed them."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "seq", "text")))
    return notes.groupBy("session_id").agg(F.transform(listed, lambda x: x["text"]).alias(name))


def judge(view: DataFrame, chains: DataFrame, producer: Producer = DEFAULT_PRODUCER) -> DataFrame:
    """Status, notes, coverage and errors of every session, as arrays."""
    flags = session_flags(view)
    degraded = degradations(view, producer, flags)
    parts = [
        integrity(degraded, chains).select("session_id", "status"),
        flags.select("session_id", "closed", "coverage"),
        gather(degraded, "degraded"),
        gather(limitations(view, producer, flags), "limitations"),
        gather(interference(view, producer), "interference"),
        gather(recorder_errors(view), "recorder_errors"),
    ]
    joined = reduce(lambda a, b: a.join(b, "session_id", "left"), parts)
    lists = ("degraded", "limitations", "interference", "recorder_errors")
    empty = F.array().cast("array<string>")
    return joined.withColumns(
        {c: F.coalesce(c, empty) for c in lists} | {"closed": F.coalesce("closed", F.lit(False))}
    )
