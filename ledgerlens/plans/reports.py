"""Session reports as tables over every session at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.narrate import (
    fact_assumptions, fact_consequence, fact_title, facts_verdict, outcome, summarize, verdict,
)
from ledgerlens.functions.paths import basename, display_path
from ledgerlens.operators.chain import verify_chain
from ledgerlens.operators.facts import ground_truth
from ledgerlens.operators.ordered import attach, hash_salt, seq_bucket
from ledgerlens.schemas import iso_ms, non_empty
from ledgerlens.settings import DEFAULT_PRODUCER, FACT_CATALOG, Producer

FILE_CHANGE = ("file.write", "file.delete")


def with_cwd(view: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with the working directory of their session, as ``session_cwd``."""
    cwd = sessions.select(F.col("id").alias("session_id"), F.col("cwd").alias("session_cwd"))
    return attach(view, cwd, ["session_id"], seq_bucket())


def cited_events(facts: DataFrame) -> DataFrame:
    return facts.select("session_id", F.explode("evidence.eventId").alias("id")).distinct()


def timeline(view: DataFrame, sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """W7, Q10 replay: every event with its one line and whether a fact cites it."""
    cited = cited_events(facts).withColumn("cited", F.lit(True))
    rows = with_cwd(view, sessions).join(cited, ["session_id", "id"], "left")
    cwd = F.coalesce("session_cwd", F.lit(""))
    return rows.select(
        "session_id", "seq", "id", "ts", "kind", F.col("signal_tier").alias("tier"),
        summarize(cwd).alias("summary"), F.coalesce("cited", F.lit(False)).alias("cited"),
    )


def cited_evidence(view: DataFrame, sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """The events that facts point at."""
    rows = with_cwd(view, sessions).join(cited_events(facts), ["session_id", "id"], "left_semi")
    return rows.select(
        "session_id", F.col("id").alias("event_id"), "seq", "ts", "kind", "source",
        F.col("path").alias("target"), summarize(F.coalesce("session_cwd", F.lit(""))).alias("summary"),
    )


def fact_steps(view: DataFrame, sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """Q8 views: what was observed for each fact, in the order it occurred."""
    pointers = facts.select(
        "session_id", "fact_id", "ts", "tie", F.explode("evidence").alias("p")
    ).select("session_id", "fact_id", F.col("ts").alias("fact_ts"), "tie", F.col("p.eventId").alias("id"))
    rows = with_cwd(view, sessions).join(pointers, ["session_id", "id"])
    written = (F.col("kind") == "file.write") & F.col("mtime_ms").isNotNull()
    return rows.select(
        "session_id", "fact_id", "fact_ts", "tie", F.lit("observed").alias("state"), "seq",
        F.when(written, iso_ms(F.col("mtime_ms"))).otherwise(F.col("ts")).alias("occurred_ts"),
        summarize(F.coalesce("session_cwd", F.lit(""))).alias("text"),
    ).unionByName(facts.where(fact_consequence(F.col("fact_id")).isNotNull()).select(
        "session_id", "fact_id", F.col("ts").alias("fact_ts"), "tie",
        F.lit("consequence").alias("state"), F.lit(None).cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("occurred_ts"),
        fact_consequence(F.col("fact_id")).alias("text"),
    ))


# Why a change has no content to show.
CONTENT_NOTES = {
    "sensitive": ("withheld", "This path is credential-shaped, so its contents were never read — not by the "
                  "recorder, and not into the record. The change is real; the bytes are not here."),
    "oversized": ("oversized", "Larger than the snapshot limit, so no content was stored. The change is "
                  "recorded; the diff is not available."),
    "unreadable": ("never-captured", "{label} saw this file change and could not read it. This is a real gap in "
                   "the record, not an empty diff."),
}
BINARY_NOTE = "Binary file — there is no readable diff to show."
MISSING_NOTE = (
    "The content snapshot for this file is no longer in the blob store. Blobs are deletable by "
    "design (they are not hash-chained), so this is expected after a cleanup — but the diff "
    "cannot be shown."
)


def _content(producer: Producer) -> Column:
    state = lambda s, note: F.struct(F.lit(s).alias("content"), F.lit(note).cast("string").alias("note"))
    chain = F
    for reason, (s, note) in CONTENT_NOTES.items():
        chain = chain.when(F.col("content_withheld") == reason, state(s, note.format(label=producer.label)))
    return chain.when(F.col("binary"), state("binary", BINARY_NOTE)).when(
        F.coalesce("after_ref", "before_ref").isNotNull(), state("available", None)
    )


def _touched(view: DataFrame) -> DataFrame:
    path = non_empty(F.coalesce("path", "payload_path"))
    return ground_truth(view).where(F.col("kind").isin(*FILE_CHANGE)).withColumn("touched", path).where(
        F.col("touched").isNotNull()
    )


def file_changes(
    view: DataFrame, sessions: DataFrame, blobs: DataFrame | None = None,
    producer: Producer = DEFAULT_PRODUCER,
) -> DataFrame:
    """One row per session and path.  Its events are in :func:`change_events`."""
    is_write = F.col("kind") == "file.write"
    of_write = lambda c: F.when(is_write & c.isNotNull(), F.col("seq"))
    state = _content(producer)
    rows = _touched(view).withColumn("state", state)
    changes = rows.groupBy("session_id", F.col("touched").alias("path")).agg(
        F.min_by(F.coalesce("in_scope", F.lit(False)), "seq").alias("in_scope"),
        (F.max_by("kind", "seq") == "file.delete").alias("deleted"),
        F.count_if(is_write).alias("writes"),
        F.count(F.lit(1)).alias("events"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.min_by("before_ref", of_write(F.col("before_ref"))).alias("before_ref"),
        F.max_by("after_ref", of_write(F.col("after_ref"))).alias("after_ref"),
        F.max_by("state", of_write(F.col("state"))).alias("state"),
    )
    cwd = sessions.select(F.col("id").alias("session_id"), F.col("cwd").alias("session_cwd"))
    out = attach(changes, cwd, ["session_id"], hash_salt("path")).select(
        "session_id", "path",
        display_path(F.col("path"), F.coalesce("session_cwd", F.lit(""))).alias("display"),
        basename(F.col("path")).alias("name"), "in_scope", "deleted", "writes", "events",
        "first_ts", "last_ts",
        F.coalesce("state.content", F.lit("never-captured")).alias("content"),
        F.col("state.note").alias("content_note"), "before_ref", "after_ref",
    )
    return out if blobs is None else mark_missing_blobs(out, blobs)


def mark_missing_blobs(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Changes whose snapshot is gone; only distinct references meet the blob table."""
    available = F.col("content") == "available"
    refs = changes.where(available).select(F.explode(F.array_compact(
        F.array("before_ref", "after_ref"))).alias("ref")).distinct()
    gone = refs.join(blobs.select("ref"), "ref", "left_anti")
    salt = hash_salt("session_id", "path")
    lost = lambda c: gone.select(F.col("ref").alias(c), F.lit(True).alias(f"{c}_gone"))
    marked = attach(attach(changes, lost("before_ref"), ["before_ref"], salt), lost("after_ref"), ["after_ref"], salt)
    missing = available & (F.coalesce("before_ref_gone", F.lit(False)) | F.coalesce("after_ref_gone", F.lit(False)))
    return marked.select(*[
        F.when(missing, "blob-missing").otherwise(F.col(c)).alias(c) if c == "content"
        else F.when(missing, MISSING_NOTE).otherwise(F.col(c)).alias(c) if c == "content_note"
        else F.col(c)
        for c in changes.columns
    ])


def change_events(view: DataFrame) -> DataFrame:
    """The events behind each change, as rows."""
    return _touched(view).select("session_id", F.col("touched").alias("path"), "seq", "id")


def git_view(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per session the last git status, and the commits as rows."""
    gt = ground_truth(view)
    git = gt.where(F.col("kind").startswith("git."))
    status = F.when(F.col("kind") == "git.status", F.col("seq"))
    views = git.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "git.commit").alias("commits"),
        F.max_by(F.struct("branch", "head", F.when(F.col("dirty_known"), F.col("dirty")).alias("dirty")), status).alias("s"),
    ).select("session_id", "commits", "s.branch", "s.head", F.col("s.dirty").alias("dirty_at_end"))
    commits = gt.where(F.col("kind") == "git.commit").select(
        "session_id", "seq", F.coalesce("sha", "path", F.lit("unknown")).alias("sha"), "branch", "ts",
        F.col("id").alias("event_id"),
    )
    return views, commits


def counters(view: DataFrame) -> DataFrame:
    """A10: counts over every tier.  Paths become distinct before they are counted."""
    is_change = F.col("kind").isin(*FILE_CHANGE) & F.col("path").isNotNull()
    per_path = view.groupBy("session_id", F.when(is_change, F.col("path")).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "process.exit").alias("commands")
    )
    return per_path.groupBy("session_id").agg(
        F.sum("n").alias("events"), F.sum("commands").alias("commands"), F.count("p").alias("files_changed")
    )


def outcomes(view: DataFrame) -> DataFrame:
    """How each session ended, from its first end event in any tier."""
    ends = F.when(F.col("kind") == "session.end", F.col("seq"))
    per = view.groupBy("session_id").agg(
        F.count(ends).alias("n"), F.min_by(F.struct("end_exit_code"), ends).alias("e")
    )
    o = outcome(F.col("n") > 0, F.col("e.end_exit_code"))
    return per.select("session_id", o.alias("o")).select("session_id", "o.state", "o.exit_code", "o.text")


def session_index(
    sessions: DataFrame, view: DataFrame, facts: DataFrame, judged: DataFrame, limit: int | None = None
) -> DataFrame:
    """One row per session; ``judged`` is ``judge.integrity`` with ``closed``.

    With ``limit``, the newest sessions are picked before anything is counted.
    """
    newest = sessions if limit is None else sessions.orderBy(F.desc("number")).limit(limit)
    ids = newest.select(F.col("id").alias("session_id"))
    only = lambda df: df if limit is None else df.join(ids, "session_id", "left_semi")
    n_facts = only(facts).groupBy("session_id").agg(F.count(F.lit(1)).alias("fact_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = (
        newest.withColumnRenamed("id", "session_id").join(only(counters(view)), "session_id", "left")
        .join(n_facts, "session_id", "left").join(only(judged), "session_id", "left")
    )
    status = F.coalesce("status", F.lit("DEGRADED"))
    return joined.select(
        "session_id", "number", "runtime_id", "mission", "started_at", "ended_at",
        status.alias("status"), facts_verdict(status, F.coalesce("fact_count", F.lit(0))).alias("facts_verdict"),
        zero("fact_count"), F.coalesce("closed", F.lit(False)).alias("closed"),
        zero("files_changed"), zero("commands"), zero("events"),
    )


def session_verdicts(index: DataFrame, gaps: DataFrame) -> DataFrame:
    """C23 over an index and ``gaps(session_id, gaps)``."""
    v = verdict(F.col("status"), F.col("fact_count"), F.coalesce("gaps", F.lit(0)))
    return index.join(gaps, "session_id", "left").select("session_id", "status", v.alias("v")).select(
        "session_id", "status", "v.finding", "v.finding_tone", "v.coverage", "v.coverage_tone"
    )


def explain_catalog(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """Q10: what was checked in each session and how often it fired; silence is a row too."""
    catalog = sessions.select(
        F.col("id").alias("session_id"), F.explode(F.array(*[F.lit(f) for f in FACT_CATALOG])).alias("fact_id")
    )
    fired = facts.groupBy("session_id", "fact_id").agg(F.count(F.lit(1)).alias("findings"))
    return catalog.join(fired, ["session_id", "fact_id"], "left").select(
        "session_id", "fact_id", fact_title(F.col("fact_id")).alias("title"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )


def explain_facts(facts: DataFrame) -> DataFrame:
    """Facts with their title, consequence and assumptions."""
    return facts.select(
        "*", fact_title(F.col("fact_id")).alias("title"),
        fact_consequence(F.col("fact_id")).alias("consequence"),
        fact_assumptions(F.col("fact_id")).alias("assumptions"),
    )


def status_report(sessions: DataFrame, raw: DataFrame, exact: bool = True) -> DataFrame:
    """Q13: the latest session, how much was captured and whether its chain holds.

    Only that session's events are checked; ``raw`` is cut to them before anything else.
    """
    latest = sessions.orderBy(F.desc("number")).limit(1)
    held = raw.join(latest.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    chains = verify_chain(held, exact)
    counted = held.groupBy("session_id").agg(F.count(F.lit(1)).alias("events_captured"))
    return (
        latest.withColumnRenamed("id", "session_id").join(counted, "session_id", "left")
        .join(chains.select("session_id", "intact", "events_checked", "broken_at", "reason"), "session_id", "left")
        .select(
            "session_id", "number", F.col("ended_at").isNull().alias("open"),
            F.coalesce("events_captured", F.lit(0)).alias("events_captured"),
            F.coalesce("intact", F.lit(True)).alias("intact"), "broken_at", "reason",
        )
    )


def session_listing(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Q14: sessions, newest first, with mission, start and duration, or open."""
    ms = lambda c: F.unix_millis(F.try_to_timestamp(c))
    newest = sessions.orderBy(F.desc("number"))
    if limit is not None:
        newest = newest.limit(limit)
    return newest.select(
        "number", F.coalesce("mission", F.lit("(no mission recorded)")).alias("label"), "started_at",
        (ms(F.col("ended_at")) - ms(F.col("started_at"))).alias("duration_ms"),
        F.col("ended_at").isNull().alias("open"),
    )


def session_report(
    view: DataFrame, sessions: DataFrame, facts: DataFrame, judged: DataFrame,
    blobs: DataFrame | None = None, producer: Producer = DEFAULT_PRODUCER,
) -> dict[str, DataFrame]:
    """Q8: all report tables; filter any of them by session for one report."""
    index = session_index(sessions, view, facts, judged)
    git, commits = git_view(view)
    replay = timeline(view, sessions, facts)
    return {
        "index": index,
        "verdicts": session_verdicts(index, judged.select("session_id", "gaps")),
        "outcomes": outcomes(view),
        "facts": explain_facts(facts),
        "steps": fact_steps(view, sessions, facts),
        "evidence": cited_evidence(view, sessions, facts),
        "timeline": replay,
        "commands": replay.where(F.col("kind") == "process.exit"),
        "changes": file_changes(view, sessions, blobs, producer),
        "change_events": change_events(view),
        "git": git, "commits": commits,
    }
