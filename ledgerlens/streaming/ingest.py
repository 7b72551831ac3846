"""Live ingest of ledger events.

A session's state is two values, the last sequence number and the last hash, kept in
the state store with those of its bucket: a restarted query goes on from there and never reads its sink.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlens.functions.canon import event_body
from ledgerlens.operators.chain import canonical_docs
from ledgerlens.operators.cleaning import classify_events, redact_ledger
from ledgerlens.operators.facts import evaluate
from ledgerlens.schemas import DRAFT_COLUMNS, EVIDENCE, RAW_EVENTS, non_empty, number_at, payload_view, text_at
from ledgerlens.settings import DEFAULT_PRODUCER, GENESIS, Producer

# Stands for the sequence number until state assigns it; JSON text cannot contain it.
SLOT = "\u0001"
DEBOUNCE_MS = 120

_SEALED = [part.split(" ")[0] for part in RAW_EVENTS.split(", ")]


def read_drafts(spark, path: str, schema: str | T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def without_repeats(drafts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An event id counts once within the watermark."""
    return (
        drafts.withColumn("ts_ts", F.try_to_timestamp("ts"))
        .withWatermark("ts_ts", delay)
        .dropDuplicatesWithinWatermark(["id"])
        .drop("ts_ts")
    )


#: Groups that sessions are dealt to, so that a batch calls Python a bounded number of times.
CHAIN_BUCKETS = 4096


def _chain_bucket(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Chain the new events of every session of a bucket; its state holds their last numbers and hashes."""
    import hashlib

    known = {session: (seq, head) for session, seq, head in zip(*state.get)} if state.exists else {}
    # A micro-batch arrives in any order; (ts, id) makes the chain's order its own.
    batch = pd.concat(parts).sort_values(["session_id", "ts", "id"], kind="stable", ignore_index=True)
    session, seq, head = None, *known.get(None, (0, GENESIS))
    seqs, prevs, hashes = [], [], []
    for owner, before, after in zip(batch["session_id"], batch["h"], batch["t"]):
        owner = owner if isinstance(owner, str) else None
        if owner != session:
            known[session] = seq, head
            session, (seq, head) = owner, known.get(owner, (0, GENESIS))
        seq += 1
        seqs.append(seq)
        prevs.append(head)
        head = hashlib.sha256((head + before + head + after.replace(SLOT, str(seq))).encode("utf-8")).hexdigest()
        hashes.append(head)
    known[session] = seq, head
    held = [(owner, *last) for owner, last in known.items() if last[0]]
    state.update(tuple(map(list, zip(*held))))
    batch["seq"], batch["prev_hash"], batch["hash"] = seqs, prevs, hashes
    yield batch[_SEALED]


def classified(drafts: DataFrame) -> DataFrame:
    """C7, C8 on drafts: what a recorder has not classified itself is classified before the chain."""
    stated = ("effect_class", "blast_radius", "reversible")
    p, s = F.try_parse_json("payload"), F.try_parse_json("snapshot_ref")
    found = classify_events(
        drafts.withColumnsRenamed({c: f"_{c}" for c in stated}).withColumns({
            "command": text_at(p, "$.command"), "bytes_before": number_at(p, "$.bytesBefore"),
            "before_ref": non_empty(text_at(s, "$.before")), "after_ref": non_empty(text_at(s, "$.after")),
        })
    )
    own = F.col("_effect_class").isNotNull()
    return found.withColumns(
        {c: F.when(own, F.col(f"_{c}")).otherwise(F.col(c)) for c in stated}
    ).select(*drafts.columns)


def seal_stream(drafts: DataFrame, exact: bool = True) -> DataFrame:
    """Classify, redact, canonicalise and chain; whole events (schemas.RAW_EVENTS).

    Sessions share ``CHAIN_BUCKETS`` groups.  A group's part of one micro-batch is sorted in
    memory: ``read_drafts(max_files=...)`` bounds it.
    """
    clean = redact_ledger(classified(drafts.select(*DRAFT_COLUMNS))).drop("redaction_count")
    docs = canonical_docs(clean, exact)
    head, tail = event_body()
    slotted = docs.withColumn("seq", F.lit(SLOT))
    bodies = slotted.select(*DRAFT_COLUMNS, head.alias("h"), tail.alias("t"))
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(CHAIN_BUCKETS)).cast("int")
    return bodies.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _chain_bucket, RAW_EVENTS, "session_id array<string>, seq array<bigint>, head array<string>", "append",
        GroupStateTimeout.NoTimeout,
    )


def start_sealing(drafts: DataFrame, sink: str, checkpoint: str, exact: bool = True) -> StreamingQuery:
    return (
        seal_stream(drafts, exact).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# ---- rows without a time -----------------------------------------------------------------

def untimed(rows: DataFrame) -> DataFrame:
    """What T3 and T4 refuse: rows without ``ts_ms``, which no watermark can place, with the reason.

    Stateless, so it runs as a query of its own beside them or over a table.
    """
    return rows.where(F.col("ts_ms").isNull()).withColumn("reason", F.lit("no time (ts_ms)"))


# ---- T3: no-op writes and bursts ------------------------------------------------------

_WRITE = "session_id string, path string, id string, ts_ms bigint, before_ref string, after_ref string"


#: Groups that paths are dealt to, so that a batch calls Python a bounded number of times.
WRITE_BUCKETS = 1024
_HELD = ("session_id", "path", "id", "ts_ms", "before_ref", "after_ref")


def _settle_bucket(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold the writes of each path until the watermark has passed them and the quiet time after
    them, so that late rows take their place before bursts are put together."""
    held = list(zip(*state.get)) if state.exists else []
    if not state.hasTimedOut:
        for part in parts:
            held += list(part[list(_HELD)].itertuples(index=False, name=None))
    paths: dict[tuple, list[tuple]] = {}
    for write in held:
        paths.setdefault(write[:2], []).append(write)
    passed, out, open_, wake = state.getCurrentWatermarkMs(), [], [], []
    for writes in paths.values():
        writes.sort(key=lambda w: (w[3], w[2] is None, w[2]))
        bursts: list[list[tuple]] = []
        for write in writes:
            if bursts and write[3] - bursts[-1][-1][3] <= DEBOUNCE_MS:
                bursts[-1].append(write)
            else:
                bursts.append([write])
        done = [b for b in bursts if b[-1][3] + DEBOUNCE_MS < passed]
        out += [(*b[0][:2], b[-1][2], int(b[-1][3]), b[0][4], b[-1][5]) for b in done]
        if len(done) < len(bursts):
            open_ += [w for b in bursts[len(done):] for w in b]
            wake.append(int(bursts[len(done)][-1][3]) + DEBOUNCE_MS + 1)
    if open_:
        state.update(tuple(map(list, zip(*open_))))
        state.setTimeoutTimestamp(max(min(wake), passed + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame([w for w in out if w[4] is None or w[4] != w[5]], columns=list(_HELD))


def settled_writes(writes: DataFrame, delay: str = "1 second") -> DataFrame:
    """T3 over ``_WRITE`` columns: bursts within 120 ms collapse, no-op writes vanish.

    Writes without a time never reach the state; ``untimed`` returns them.  Paths share
    ``WRITE_BUCKETS`` groups, each with the open writes of its paths as its state.
    """
    bucket = F.pmod(F.xxhash64("session_id", "path"), F.lit(WRITE_BUCKETS)).cast("int")
    return (
        writes.where(F.col("ts_ms").isNotNull()).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
        .withColumn("bucket", bucket).groupBy("bucket")
        .applyInPandasWithState(
            _settle_bucket, _WRITE,
            "session_id array<string>, path array<string>, id array<string>, ts_ms array<bigint>, "
            "before_ref array<string>, after_ref array<string>",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


# ---- T4: sessions that end, and those that never do ------------------------------------

_STATUS = "session_id string, status string, last_ms bigint"


def _watch_session(quiet_ms: int):
    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A session ends once; its mark stays for another quiet time, so late events do not open it again."""
        out = []
        last, ended = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            if not ended:
                out.append((key[0], "stale", last))
            state.remove()
        else:
            closed = ended
            for part in parts:
                last = max(last, int(part["ts_ms"].max()))
                ended = ended or bool((part["kind"] == "session.end").any())
            if ended and not closed:
                out.append((key[0], "closed", last))
            state.update((last, ended))
            state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "status", "last_ms"])

    return watch


def session_status(events: DataFrame, quiet_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """T4: ``closed`` when a session ends, ``stale`` when it falls silent without an end.

    A silence longer than ``quiet_ms`` that spans arrivals makes a session stale; if it goes
    on, it is watched anew.  Events without a time are left to ``untimed``.
    """
    return (
        events.where(F.col("ts_ms").isNotNull()).select("session_id", "kind", "ts_ms", F.timestamp_millis("ts_ms").alias("at"))
        .withWatermark("at", delay).groupBy("session_id")
        .applyInPandasWithState(
            _watch_session(quiet_ms), _STATUS, "last_ms bigint, ended boolean", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


# ---- T5: facts that follow the ledger ---------------------------------------------------

_FACTS = f"session_id string, fact_id string, statement string, confidence string, ts string, tie bigint, evidence {EVIDENCE}"
#: Parts that a stored ledger is kept in; a session's rows are all in one.
LEDGER_BUCKETS = 256
#: Tasks that write them; files cost time by their number, so their bytes must not decide it.
LEDGER_WRITERS = 64


def ledger_bucket(session: str = "session_id") -> Column:
    return F.pmod(F.xxhash64(session), F.lit(LEDGER_BUCKETS)).cast("int")


def stored_ledger(spark: SparkSession, ledger_path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The ledger that ``start_facts`` keeps (or its parsed events), or the given parts of it; no other part is read."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    rows = spark.read.schema(whole).parquet(ledger_path)
    kept = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    return kept.drop("bucket", "batch")


def _write_parts(rows: DataFrame, path: str) -> None:
    """Write into the partitions that the rows name and replace only those; one task and one file for each."""
    parted = rows.repartition(LEDGER_WRITERS, "bucket").sortWithinPartitions("bucket", "batch")
    parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def start_facts(
    sealed: DataFrame, ledger_path: str, facts_path: str, checkpoint: str,
    producer: Producer = DEFAULT_PRODUCER, ended_only: bool = False,
) -> StreamingQuery:
    """T5: each micro-batch re-judges only the sessions it touched.

    The ledger lies in ``LEDGER_BUCKETS`` parts by session, and a batch reads the parts of its
    sessions.  Payloads are parsed once, when they arrive: the parsed events lie beside the facts,
    in parts like the ledger's (made of the whole ledger where they are missing), and only their
    columns are read again.  Every batch owns its partitions of all outputs and replaces them when it is
    retried, so a batch that ran twice is not counted twice.  With ``ended_only`` a session is
    judged when its ``session.end`` comes, and again if rows come after that.
    """
    def judge_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumns({"bucket": ledger_bucket(), "batch": F.lit(batch_id).cast("bigint")})
        _write_parts(placed, ledger_path)
        stored = spark.read.schema(placed.schema).parquet(ledger_path)
        own = stored.where(F.col("batch") == batch_id)
        views = f"{facts_path}/views"
        fresh = payload_view((own if _exists(spark, views) else stored).drop("bucket", "batch"), producer).drop("_p")
        at = {"bucket": ledger_bucket(), "batch": F.lit(batch_id).cast("bigint")}
        _write_parts(fresh.withColumns(at), views)
        touched = own.select("session_id", "bucket", "batch").distinct()
        # At most LEDGER_BUCKETS numbers.
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]
        ledger = stored_ledger(spark, views, fresh.schema, buckets)
        if ended_only:
            over = ledger.where(F.col("kind") == "session.end").select("session_id").distinct()
            touched = touched.join(over, "session_id", "left_semi")
        sessions = touched.select("session_id").distinct()
        found = evaluate(ledger.join(sessions, "session_id", "left_semi"))
        _write_parts(found.withColumns(at), f"{facts_path}/facts")
        _write_parts(touched, f"{facts_path}/touched")

    return (
        sealed.writeStream.foreachBatch(judge_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_facts(spark: SparkSession, facts_path: str) -> DataFrame:
    """Facts of each session as of the last batch that judged it."""
    touched = spark.read.schema("session_id string, bucket int, batch bigint").parquet(f"{facts_path}/touched")
    latest = touched.groupBy("bucket", "session_id").agg(F.max("batch").alias("batch"))
    facts = spark.read.schema(f"{_FACTS}, bucket int, batch bigint").parquet(f"{facts_path}/facts")
    return facts.join(latest, ["bucket", "session_id", "batch"]).drop("bucket", "batch")
