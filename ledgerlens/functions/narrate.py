"""One-line event summaries and the wording of facts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.paths import display_path
from ledgerlens.schemas import number_text

# Report wording.
FACT_TITLES = {
    "RF-01": "Command failed",
    "RF-02": "Uncommitted work left behind",
    "RF-03": "No test command observed",
    "RF-04": "Code changed after testing",
    "RF-05": "File reverted",
    "RF-06": "Process killed",
    "RF-07": "Change outside the project",
}
FACT_CONSEQUENCES = {
    "RF-03": "Nothing was observed to verify these changes.",
    "RF-04": "No test run was observed after this change.",
    "RF-06": "The work may be half-complete.",
}
FACT_ASSUMPTIONS = {
    "RF-04": (
        "Ordering is by filesystem modification time versus the test run\u2019s exit time. It is "
        "wrong if the system clock moved backward during the session, or if the filesystem "
        "records only coarse (second-granularity) modification times.",
        "Modification times can be set by any process, so they are evidence, not proof.",
    ),
}
NOT_CLOSED = (
    "no session end was recorded \u2014 the session is still running, or the wrapper did not close it"
)
KILLED = "the agent was killed by a signal; no exit code exists"


def lookup(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    chain = F
    for k, v in values.items():
        chain = chain.when(key == k, v)
    return chain.otherwise(F.lit(None) if default is None else default)


def fact_title(fact_id: Column) -> Column:
    return lookup(FACT_TITLES, fact_id, fact_id)


def fact_consequence(fact_id: Column) -> Column:
    return lookup(FACT_CONSEQUENCES, fact_id)


def fact_assumptions(fact_id: Column) -> Column:
    chain = F
    for k, texts in FACT_ASSUMPTIONS.items():
        chain = chain.when(fact_id == k, F.array(*[F.lit(t) for t in texts]))
    return chain.otherwise(F.array().cast("array<string>"))


def summarize(cwd: Column) -> Column:
    """C15 over the columns of ``payload_view``."""
    kind = F.col("kind")
    shown = display_path(F.coalesce("path", F.lit("")), cwd)
    written = display_path(F.coalesce("path", "payload_path", F.lit("")), cwd)
    code = F.coalesce(number_text(F.col("exit_code")), F.lit("unknown"))
    end = F.coalesce(
        number_text(F.col("end_exit_code")), F.lit("unknown \u2014 killed by a signal")
    )
    dirty = F.coalesce(F.size("dirty"), F.lit(0))
    withheld = F.coalesce(
        F.concat(F.lit(" (content withheld: "), "content_withheld", F.lit(")")), F.lit("")
    )
    command = F.coalesce("command", F.lit("undefined"))
    return (
        F.when(
            (kind == "process.exit") & F.col("signal").isNotNull(),
            F.concat(command, F.lit(" was terminated by "), "signal"),
        )
        .when(kind == "process.exit", F.concat(command, F.lit(" exited with code "), code))
        .when(kind == "process.spawn", F.concat(F.lit("ran "), F.coalesce("spawn_command", F.lit("undefined"))))
        .when(kind == "file.write", F.concat(F.lit("wrote "), written, withheld))
        .when(kind == "file.delete", F.concat(F.lit("deleted "), shown))
        .when(kind == "file.read", F.concat(F.lit("read "), shown))
        .when(kind == "git.commit", F.trim(F.concat(F.lit("committed "), F.coalesce("sha", F.lit("")))))
        .when(kind == "git.ref_update", "git HEAD moved")
        .when(
            (kind == "git.status") & (dirty > 0),
            F.concat(F.lit("git working tree had "), dirty.cast("string"), F.lit(" uncommitted file(s)")),
        )
        .when(kind == "git.status", "git working tree was clean")
        .when(kind == "session.start", "session started")
        .when(kind == "session.end", F.concat(F.lit("session ended (exit "), end, F.lit(")")))
        .when(kind == "mission.stated", "mission stated")
        .when(kind == "net.request", F.concat(F.lit("network request to "), F.coalesce("path", F.lit("unknown host"))))
        .when(kind == "agent.output", "agent output")
        .otherwise(kind)
    )


def _counted(n: Column, noun: str, tail: str = "") -> Column:
    plural = F.when(n == 1, "").otherwise("s")
    return F.concat(n.cast("string"), F.lit(f" {noun}"), plural, F.lit(tail))


def verdict(status: Column, facts: Column, gaps: Column) -> Column:
    """A finding and, unless the record is broken, how complete the evidence is."""
    broken = status == "BROKEN"
    return F.struct(
        F.when(broken, "Record integrity broken")
        .when(facts > 0, _counted(facts, "divergence", " observed"))
        .otherwise("No divergences observed").alias("finding"),
        F.when(broken, "bad").when(facts > 0, "warn").otherwise("ok").alias("finding_tone"),
        F.when(broken, F.lit(None))
        .when(gaps > 0, F.concat(F.lit("Evidence incomplete \u00b7 "), _counted(gaps, "gap")))
        .otherwise("Evidence complete").alias("coverage"),
        F.when(broken, F.lit(None)).when(gaps > 0, "warn").otherwise("ok").alias("coverage_tone"),
    )


def facts_verdict(status: Column, facts: Column) -> Column:
    return (
        F.when(status == "BROKEN", "record-untrustworthy")
        .when(facts > 0, "divergences-observed")
        .otherwise("none-observed")
    )


def outcome(ended: Column, exit_code: Column) -> Column:
    """How the session ended, from its end event in any tier."""
    return F.struct(
        F.when(~ended, "not-closed").when(exit_code.isNull(), "killed").otherwise("exited").alias("state"),
        F.when(ended, exit_code).alias("exit_code"),
        F.when(~ended, NOT_CLOSED).when(exit_code.isNull(), KILLED)
        .otherwise(F.concat(F.lit("the agent exited with code "), number_text(exit_code))).alias("text"),
    )
