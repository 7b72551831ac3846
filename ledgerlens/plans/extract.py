"""Record documents to the four relational tables that queries read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.canon import canonical_json
from ledgerlens.functions.paths import rel_path_of
from ledgerlens.operators.identity import evidence_from
from ledgerlens.operators.record import check_read, read_objects, record_events
from ledgerlens.schemas import (
    array_at, flag_at, iso_ms, non_empty, number_at, text_at, texts_in,
)
from ledgerlens.settings import DEFAULT_PRODUCER, Producer, settle


@dataclass(frozen=True)
class GraphTables:
    records: DataFrame
    signals: DataFrame
    file_events: DataFrame
    facts: DataFrame
    unreadable: DataFrame
    evidence: DataFrame


def extract(objects: DataFrame, producer: Producer = DEFAULT_PRODUCER, exact: bool = True) -> GraphTables:
    """``source, doc`` objects to records, signals, file_events and facts.

    Documents that are altered but well-formed are extracted; others are counted.
    """
    read = read_objects(objects, exact=exact)
    checks = settle(check_read(read, producer).select("source", "verdict"), "extract-checks")
    parsed = read.even.select("source", "v")
    if read.odd is not None:
        # Only documents with odd numbers or repeated keys go through Python.
        parsed = parsed.unionByName(read.odd.select("source", F.try_parse_json(canonical_json(F.col("doc"))).alias("v")))
    v = F.col("v")
    events = record_events(parsed, exact=False)
    p = lambda path: text_at(F.col("e"), f"$.payload.{path}")
    start = (
        events.where((F.col("kind") == "session.start") & (F.col("signal_tier") == "groundTruth"))
        .groupBy("source").agg(F.min_by(F.struct(
            p("machineId").alias("machine_id"), p("cwd").alias("cwd"),
            F.transform(
                array_at(F.col("e"), "$.payload.gitRemotes"),
                lambda r: F.struct(text_at(r, "$.name").alias("name"), text_at(r, "$.url").alias("url")),
            ).alias("git_remotes"),
            texts_in(array_at(F.col("e"), "$.payload.gitRootCommits")).alias("git_root_commits"),
        ), "pos").alias("start"))
    )
    # Documents stay where they lie: what is taken of them meets the checks, not they themselves.
    stated = parsed.select(
        "source",
        text_at(v, "$.recordId").alias("record_id"),
        text_at(v, "$.subject.sessionId").alias("session_id"),
        text_at(v, "$.observations.head").alias("chain_head"),
        text_at(v, "$.subject.runtimeId").alias("runtime_id"),
        text_at(v, "$.identity.machineId").alias("machine_id"), text_at(v, "$.subject.cwd").alias("cwd"),
        text_at(v, "$.subject.startedAt").alias("started_at"),
        text_at(v, "$.subject.endedAt").alias("ended_at"),
        text_at(v, "$.generator.name").alias("generator_name"),
        text_at(v, "$.generator.version").alias("generator_version"),
        text_at(v, "$.evidence.integrity.status").alias("integrity_status"),
        number_at(v, "$.observations.count").cast("bigint").alias("event_count"),
        F.size(array_at(v, "$.evidence.facts")).cast("bigint").alias("fact_count"),
        texts_in(array_at(v, "$.evidence.catalog")).alias("catalog"),
    ).join(checks.where(F.col("verdict") != "invalid"), "source", "left_semi")
    own = [c for c in stated.columns if c not in ("machine_id", "cwd")]
    frames = settle(stated.join(start, "source", "left").select(
        *own[:own.index("started_at")],
        F.coalesce("start.machine_id", "machine_id").alias("machine_id"), F.coalesce("start.cwd", "cwd").alias("cwd"),
        *own[own.index("started_at"):],
        F.col("start.git_remotes").alias("git_remotes"),
        F.col("start.git_root_commits").alias("git_root_commits"),
    ), "extract-frames")
    # The same record may be stored under two sources; it is one row.
    frames = frames.dropDuplicates(["record_id"])
    evidence = evidence_from(frames)
    signals = evidence.select("record_id", F.explode(F.concat(
        F.transform(F.array_compact(F.array("origin")), lambda x: F.struct(F.lit("origin").alias("kind"), x.alias("value"))),
        F.transform("remotes", lambda x: F.struct(F.lit("remote").alias("kind"), x.alias("value"))),
        F.transform("roots", lambda x: F.struct(F.lit("root").alias("kind"), x.alias("value"))),
    )).alias("s")).select("record_id", "s.kind", "s.value")

    ids = frames.select("source", "record_id", "cwd")
    e = F.col("e")
    path = F.coalesce(text_at(e, "$.target.resolved"), text_at(e, "$.payload.path"))
    mtime = number_at(e, "$.payload.mtimeMs")
    scoped = F.coalesce(flag_at(e, "$.target.inScope"), F.lit(False))
    file_events = (
        events.where(
            (F.col("signal_tier") == "groundTruth") & F.col("kind").isin("file.write", "file.delete")
        )
        .join(ids, "source")
        .select(
            "record_id", F.col("seq").cast("bigint").alias("seq"), "ts",
            F.coalesce(iso_ms(mtime), F.col("ts")).alias("occurred_ts"),
            F.when(mtime.isNotNull(), "mtime").otherwise("event").alias("occurred_source"),
            "kind", F.when(scoped, rel_path_of(F.col("cwd"), path)).alias("rel_path"),
            non_empty(path).alias("abs_path"), scoped.alias("in_scope"),
            number_at(e, "$.payload.bytesBefore").cast("bigint").alias("bytes_before"),
            number_at(e, "$.payload.bytesAfter").cast("bigint").alias("bytes_after"),
            text_at(e, "$.payload.contentWithheld").alias("content_withheld"),
        )
        .where(F.col("abs_path").isNotNull())
    )
    f = F.col("f")
    listed = parsed.select(
        "source", F.posexplode(array_at(v, "$.evidence.facts")).alias("ord", "f")
    ).select(
        "source", "ord", text_at(f, "$.id").alias("fact_id"),
        text_at(f, "$.statement").alias("statement"), text_at(f, "$.confidence").alias("confidence"),
        text_at(f, "$.ts").alias("ts"),
        F.transform(array_at(f, "$.evidence"), lambda p: F.struct(
            text_at(p, "$.source").alias("source"), text_at(p, "$.eventId").alias("eventId"),
            number_at(p, "$.eventSeq").cast("bigint").alias("eventSeq"), text_at(p, "$.ts").alias("ts"),
        )).alias("evidence"),
    )
    facts = listed.join(ids.select("source", "record_id"), "source").drop("source")
    unreadable = checks.agg(F.count_if(F.col("verdict") == "invalid").alias("unreadable"))
    records = frames.drop("source", "git_remotes", "git_root_commits")
    return GraphTables(records, signals, file_events, facts, unreadable, evidence)
