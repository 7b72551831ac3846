"""Streaming queries, run to the end of what their source holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.plans import bridge
from ledgerlens.plans.oracle import with_base
from ledgerlens.plans.queries_ledger import RAW_SQL, flat
from ledgerlens.plans.queries_report import VIEW_FACTS, VIEW_SQL, sealed
from ledgerlens.plans.register import query
from ledgerlens.settings import checkpoint_root, settle
from ledgerlens.streaming import ingest

HALF = "2024-01-16"


def scratch(spark, name):
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def in_two_parts(rows, path):
    """Write rows before and after the middle of the month as two arrivals."""
    yield rows.where(F.col("ts") < HALF).write.mode("append").parquet(path)
    yield rows.where(F.col("ts") >= HALF).write.mode("append").parquet(path)


# Redaction comes before the chain: the password of a remote is gone from the hashed bytes.
CLEAN_RAW_SQL = RAW_SQL.replace("https://u:t@", "https://u:[REDACTED]@")


# Classification comes before the chain too.
SEALED_SQL = CLEAN_RAW_SQL.replace(
    '"blastRadius":null,"effectClass":null,',
    """"blastRadius":'||coalesce('"'||blast_radius||'"','null')||',"effectClass":'||coalesce('"'||effect_class||'"','null')||',""",
).replace(
    '"reversible":null,', """"reversible":'||coalesce(CAST(reversible AS VARCHAR),'null')||',""",
).replace("FROM kn),", """,
   CASE WHEN rkind='process.exit' THEN CASE WHEN command='git push --force' THEN 'destroy' ELSE 'execute' END
     WHEN rkind='file.read' THEN 'read' WHEN rkind='file.write' THEN 'write' WHEN rkind='file.delete' THEN 'destroy' END AS effect_class,
   CASE WHEN rkind='process.exit' THEN 'repo' WHEN rkind IN ('file.read','file.write','file.delete') THEN 'file' END AS blast_radius,
   CASE WHEN rkind='process.exit' THEN CASE WHEN command='git push --force' THEN false END WHEN rkind='file.read' THEN true
     WHEN rkind='file.write' THEN before_ref IS NOT NULL OR after_ref IS NOT NULL WHEN rkind='file.delete' THEN false END AS reversible FROM kn),""")


@query("t1_stream_chain", with_base(SEALED_SQL) + """ SELECT session_id, seq, id, rkind AS kind, payload, target, effect_class, blast_radius, reversible,
   prev_hash, hash FROM raw""")
def t1_stream_chain(spark, sf_dir):
    """Chains sealed by two runs of one query, the second going on from state."""
    drafts = settle(bridge.ledger_drafts(spark, sf_dir), "stream-drafts")
    source, sink, checkpoint = (scratch(spark, n) for n in ("drafts", "chain", "chain-state"))
    for _ in in_two_parts(drafts, source):
        stream = ingest.read_drafts(spark, source, drafts.schema)
        ingest.start_sealing(stream, sink, checkpoint, exact=False).awaitTermination()
    return spark.read.parquet(sink).select(
        "session_id", "seq", "id", "kind", "payload", "target", "effect_class", "blast_radius", "reversible", "prev_hash", "hash"
    )


@query("t2_stream_without_repeats", with_base() + " SELECT id, session_id FROM b")
def t2_stream_without_repeats(spark, sf_dir):
    """Every event arrives twice."""
    e = bridge.ledger_events(spark, sf_dir).select("id", "session_id", "ts")
    source, sink, checkpoint = (scratch(spark, n) for n in ("repeats", "once", "once-state"))
    e.unionByName(e).write.parquet(source)
    stream = ingest.without_repeats(spark.readStream.schema(e.schema).parquet(source), "40 days")
    stream.writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("id", "session_id")


def run_arrivals(spark, name, arrivals, transform):
    """Feed each table as an arrival of its own to a query that goes on from its state; all that it put out."""
    source, sink, checkpoint = (scratch(spark, f"{name}-{n}") for n in ("in", "out", "state"))
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(rows.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", sink).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).where(F.col("session_id") != "end")


# A last arrival that moves the watermark past every quiet time.
END_MS = 1_800_000_000_000


@query("t3_stream_settled_writes", with_base() + """ SELECT session_id, path, id||'-2' AS id, (ts_ms+100)::BIGINT AS ts_ms, 'a' AS before_ref, 'd' AS after_ref
 FROM b WHERE kind='file.write'""")
def t3_stream_settled_writes(spark, sf_dir):
    """Each write comes as a burst of three and a later no-op, the middle of the burst first, and once without a
    time; one row is left."""
    w = settle(bridge.ledger_events(spark, sf_dir).where(F.col("kind") == "file.write").select(
        "session_id", "path", "id", "ts_ms"
    ), "writes")
    part = lambda n, ms, before, after: w.select(
        "session_id", "path", F.concat("id", F.lit(f"-{n}")).alias("id"), (F.col("ts_ms") + ms).alias("ts_ms"),
        F.lit(before).alias("before_ref"), F.lit(after).alias("after_ref"),
    )
    end = w.limit(1).select(
        F.lit("end").alias("session_id"), F.lit("end").alias("path"), F.lit("end").alias("id"),
        F.lit(END_MS).cast("bigint").alias("ts_ms"), F.lit("a").alias("before_ref"), F.lit("b").alias("after_ref"),
    )
    arrivals = [part(1, 50, "b", "c").unionByName(part(3, 400, "d", "d")), part(0, 0, "a", "b"), part(2, 100, "c", "d"), end]
    arrivals[1] = arrivals[1].unionByName(timeless(arrivals[1], "id"))
    return run_arrivals(spark, "writes", arrivals, lambda s: ingest.settled_writes(s, "40 days"))


def timeless(rows, name):
    """A row without a time beside every row."""
    return rows.withColumns({"ts_ms": F.lit(None).cast("bigint"), name: F.concat(name, F.lit("-untimed"))})


T4_SQL = """,
 h AS (SELECT session_id, ts < '2024-01-16' AS early, max(ts_ms) AS last_ms, bool_or(rkind='session.end') AS ended FROM raw GROUP BY ALL),
 w AS (SELECT max(ts_ms) FILTER (ts < '2024-01-16') - 600000 AS mark FROM raw),
 p AS (SELECT session_id, max(last_ms) FILTER (early) AS first_ms, coalesce(bool_or(ended) FILTER (early), false) AS first_ended,
   max(last_ms) FILTER (NOT early) AS next_ms, coalesce(bool_or(ended) FILTER (NOT early), false) AS next_ended FROM h GROUP BY session_id),
 q AS (SELECT *, first_ms IS NOT NULL AND first_ms + 3600000 < mark AS over FROM p, w)
 SELECT session_id, CASE WHEN first_ended THEN 'closed' ELSE 'stale' END AS status, first_ms AS last_ms FROM q
 WHERE first_ms IS NOT NULL AND (first_ended OR over OR next_ms IS NULL)
 UNION ALL SELECT session_id, CASE WHEN next_ended THEN 'closed' ELSE 'stale' END, next_ms FROM q
 WHERE next_ms IS NOT NULL AND (over OR NOT first_ended)"""


@query("t4_stream_session_status", with_base(RAW_SQL) + T4_SQL)
def t4_stream_session_status(spark, sf_dir):
    """The operator's own hour of quiet: events before and after the middle of the month, a row without a
    time beside each, then every closed session's first event once more.

    A session that is silent at the end of the first half is stale there and watched anew in the second.
    """
    raw = settle(bridge.ledger_drafts(spark, sf_dir).select(
        "session_id", "kind", "ts", F.unix_millis(F.try_to_timestamp("ts")).alias("ts_ms")
    ), "status-events")
    rows = raw.drop("ts")
    ended = rows.where(F.col("kind") == "session.end").select("session_id").distinct()
    again = rows.join(ended, "session_id", "left_semi").groupBy("session_id").agg(
        F.lit("file.read").alias("kind"), F.min("ts_ms").alias("ts_ms")
    )
    end = rows.limit(1).select(
        F.lit("end").alias("session_id"), F.lit("session.end").alias("kind"), F.lit(END_MS).cast("bigint").alias("ts_ms"),
    )
    first, second = (raw.where(part).drop("ts") for part in (F.col("ts") < HALF, F.col("ts") >= HALF))
    arrivals = [first.unionByName(timeless(first, "kind")), second.unionByName(timeless(second, "session_id")), again, end]
    return run_arrivals(spark, "status", arrivals, ingest.session_status)


@query("t3_t4_untimed", with_base() + """ SELECT session_id, id||'-untimed' AS id, 'no time (ts_ms)' AS reason FROM b""")
def t3_t4_untimed(spark, sf_dir):
    """Every event comes with and without its time; the latter are put out with the reason."""
    e = bridge.ledger_events(spark, sf_dir).select("session_id", "id", "ts_ms")
    return run_arrivals(spark, "untimed", [e, timeless(e, "id")], ingest.untimed).select("session_id", "id", "reason")


FIFTHS = ("2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25")


def in_five_parts(rows, path):
    """Write rows as five arrivals, each with one more stretch of the month."""
    edges = ("", *FIFTHS, "~")
    for low, high in zip(edges, edges[1:]):
        yield rows.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(path)
    yield rows.where(F.col("ts").isNull()).write.mode("append").parquet(path)


def facts_of_arrivals(spark, sf_dir, ended_only):
    raw = sealed(spark, sf_dir)
    names = ("sealed-in", "ledger-out", "facts-out", "facts-state")
    source, ledger, found, checkpoint = (scratch(spark, n) for n in names)
    for _ in in_five_parts(raw, source):
        stream = spark.readStream.schema(raw.schema).parquet(source)
        ingest.start_facts(stream, ledger, found, checkpoint, ended_only=ended_only).awaitTermination()
    return flat(ingest.current_facts(spark, found))


@query("t5_stream_facts", with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS) + " SELECT * FROM vf")
def t5_stream_facts(spark, sf_dir):
    """Facts kept current over five arrivals equal those of the whole ledger."""
    return facts_of_arrivals(spark, sf_dir, False)


@query("t5_stream_final_facts", with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS) + """
 SELECT * FROM vf WHERE session_id IN (SELECT session_id FROM raw WHERE rkind='session.end')""")
def t5_stream_final_facts(spark, sf_dir):
    """Facts of sessions that ended, judged when they did."""
    return facts_of_arrivals(spark, sf_dir, True)
