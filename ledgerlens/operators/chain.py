"""Hash chains: verification, heads, clock checks and building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.canon import canonical_json, chain_hash, event_body
from ledgerlens.operators.ordered import attach, ordered_view, seq_bucket
from ledgerlens.schemas import DRAFT_COLUMNS
from ledgerlens.settings import GENESIS

CLOCK_TOLERANCE_MS = 1500
DOC_COLUMNS = ("actor", "target", "payload", "snapshot_ref")


def clock_regression(events: DataFrame) -> DataFrame:
    """First ground-truth event whose wall clock fell behind the monotonic clock."""
    gt = events.where(F.col("signal_tier") == "groundTruth").select(
        "session_id", "seq", "ts_ms", "monotonic_ms"
    )
    pairs = ordered_view(
        gt, ["session_id"], seq_bucket(), ["seq"],
        lags={"prev_ts": "ts_ms", "prev_mono": "monotonic_ms"},
    )
    drift = (F.col("ts_ms") - F.col("prev_ts")) - (F.col("monotonic_ms") - F.col("prev_mono"))
    return (
        pairs.select("session_id", "seq", drift.alias("drift_ms"))
        .where(F.col("drift_ms") < -CLOCK_TOLERANCE_MS)
        .groupBy("session_id")
        .agg(F.min("seq").alias("at_seq"), F.min_by("drift_ms", "seq").alias("drift_ms"))
    )


def canonical_docs(raw: DataFrame, exact: bool = True) -> DataFrame:
    return raw.withColumns({c: canonical_json(F.col(c), exact) for c in DOC_COLUMNS})


def break_reason(position: Column, seq: Column, prev_ok: Column, hash_ok: Column) -> Column:
    return (
        F.when(
            ~seq.eqNullSafe(position),
            F.concat(
                F.lit("sequence gap: expected "), position.cast("string"),
                F.lit(", found "), F.coalesce(seq.cast("string"), F.lit("null")),
            ),
        )
        .when(~prev_ok, "prevHash does not match the previous event")
        .when(~hash_ok, "event content does not match its hash")
    )


def check_links_of_chain(raw: DataFrame, exact: bool = True) -> DataFrame:
    """Per event: its place, and why it breaks the chain if it does.

    Each row needs only its own body and the previous stored hash, so rows are
    checked in parallel; the first failing place is what a walk would report.
    """
    docs = canonical_docs(raw, exact)
    head, tail = event_body()
    bodies = docs.select(
        "session_id", "seq", "id", "prev_hash", "hash",
        chain_hash(F.col("prev_hash"), head, tail).alias("_computed"),
    )
    placed = ordered_view(
        bodies, ["session_id"], seq_bucket(), ["seq", "id"], position="place",
        lags={"_stored": "hash"},
    )
    reason = break_reason(
        F.col("place"), F.col("seq"),
        F.col("prev_hash").eqNullSafe(F.coalesce("_stored", F.lit(GENESIS))),
        F.col("_computed").eqNullSafe(F.col("hash")),
    )
    return placed.select("session_id", "seq", "place", "hash", reason.alias("reason"))


def verify_chain(raw: DataFrame, exact: bool = True) -> DataFrame:
    """One row per session with the first break, if any, and the head."""
    bad = F.col("reason").isNotNull()
    return (
        check_links_of_chain(raw, exact)
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.max_by("hash", "place").alias("head"),
            F.min_by(F.struct("place", "seq", "reason"), F.when(bad, F.col("place"))).alias("b"),
        )
        .select(
            "session_id",
            F.col("b").isNull().alias("intact"),
            F.coalesce(F.col("b.place") - 1, F.col("events")).alias("events_checked"),
            F.col("b.seq").alias("broken_at"),
            F.col("b.reason").alias("reason"),
            "events",
            "head",
        )
    )


#: Stands for the sequence number until the fold assigns it; JSON text cannot contain it.
SLOT = "\u0001"


def build_chain(drafts: DataFrame, exact: bool = True) -> DataFrame:
    """Order drafts by (ts, id), nulls last, assign seq and fold the hashes.

    The fold is sequential by definition: a session's events stream, in order, through
    one task that holds one Arrow batch at a time.  Whole rows pass through it, so events
    are put together and sorted once.
    """
    docs = canonical_docs(drafts.select(*DRAFT_COLUMNS), exact)
    head, tail = event_body()
    return fold_hashes(docs.withColumn("seq", F.lit(SLOT)).select(*DRAFT_COLUMNS, head.alias("h"), tail.alias("t")))


def fold_hashes(bodies: DataFrame) -> DataFrame:
    """Rows with ``h, t``, the body around ``prevHash`` with ``SLOT`` for its number, to rows with seq, prev_hash and hash.

    Sessions meet the fold as a stream of Arrow batches in key order, never as one
    in-memory group: partitions are cut by session and sorted by (session, ts, id).
    """
    ordered = bodies.repartition("session_id").sortWithinPartitions(
        "session_id", F.col("ts").asc_nulls_last(), F.col("id").asc_nulls_last()
    )
    kept = [f for f in bodies.schema.fields if f.name not in ("h", "t")]
    added = [T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())]
    return ordered.mapInArrow(_fold_batches, T.StructType([*kept, *added]))


def _fold_batches(batches):
    import hashlib

    import pyarrow as pa

    session, seq, prev = None, 0, GENESIS
    for batch in batches:
        seqs, prevs, hashes = [], [], []
        for sid, head, tail in zip(*(batch.column(c).to_pylist() for c in ("session_id", "h", "t"))):
            if sid != session:
                session, seq, prev = sid, 0, GENESIS
            seq += 1
            seqs.append(seq)
            prevs.append(prev)
            prev = hashlib.sha256((prev + head + prev + tail.replace(SLOT, str(seq))).encode("utf-8")).hexdigest()
            hashes.append(prev)
        rows = batch.drop_columns(["h", "t"])
        added = {"seq": pa.array(seqs, pa.int64()), "prev_hash": pa.array(prevs, pa.string()), "hash": pa.array(hashes, pa.string())}
        yield pa.RecordBatch.from_arrays([*rows.columns, *added.values()], [*rows.schema.names, *added])
