"""Jobs over whole tables: redaction, classification, remotes, paths, hashing (2.3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.canon import canonical_json, sha256
from ledgerlens.functions.classify import classify_command, classify_file_event
from ledgerlens.functions.paths import DEFAULT_IGNORE, is_ignored, rel_path_of
from ledgerlens.functions.redact import redact_json, with_redaction
from ledgerlens.functions.remotes import normalize_remote_url, strip_url_credentials
from ledgerlens.schemas import iso_ms
from ledgerlens.settings import DEFAULT_PRODUCER, Producer


def redact_ledger(drafts: DataFrame) -> DataFrame:
    """Clean payload and target of every draft before it is chained."""
    p, t = redact_json(F.col("payload")), redact_json(F.col("target"))
    return (
        drafts.withColumns({"_p": p, "_t": t})
        .withColumns({
            "payload": F.col("_p.value"), "target": F.col("_t.value"),
            "redaction_count": F.coalesce("_p.count", F.lit(0)) + F.coalesce("_t.count", F.lit(0)),
        })
        .drop("_p", "_t")
    )


def redact_text_table(df: DataFrame, text_col: str) -> DataFrame:
    """C3 over any text column: adds ``clean`` and ``n``."""
    return with_redaction(df, text_col, "clean", "n")


def classify_events(events: DataFrame) -> DataFrame:
    """Effect class, blast radius and reversibility of commands and file events."""
    snapshotted = F.col("before_ref").isNotNull() | (
        (F.col("kind") == "file.write") & F.col("bytes_before").isNull() & F.col("after_ref").isNotNull()
        if "bytes_before" in events.columns else F.lit(False)
    )
    signals = F.when(
        F.col("kind").isin("process.exit", "process.spawn"), classify_command(F.col("command"))
    ).when(
        F.col("kind").isin("file.read", "file.write", "file.delete"),
        classify_file_event(F.col("kind"), snapshotted),
    )
    return events.withColumn("_c", signals).select("*", "_c.*").drop("_c")


def hash_documents(docs: DataFrame, json_col: str, exact: bool = True) -> DataFrame:
    """Canonical text and content hash of a JSON column."""
    return docs.withColumn("canonical", canonical_json(F.col(json_col), exact)).withColumn(
        "sha256", sha256(F.col("canonical"))
    )


def normalize_remotes(signals: DataFrame, url_col: str) -> DataFrame:
    """C9, C10."""
    return signals.withColumns({
        "normalized": normalize_remote_url(F.col(url_col)),
        "stripped": strip_url_credentials(F.col(url_col)),
    })


def relate_paths(file_events: DataFrame, cwd: Column) -> DataFrame:
    """Repo-relative path and time of occurrence with its source."""
    has = F.col("mtime_ms").isNotNull()
    return file_events.withColumns({
        "rel_path": F.when(F.col("in_scope"), rel_path_of(cwd, F.col("path"))),
        "occurred_ts": F.when(has, iso_ms(F.col("mtime_ms"))).otherwise(F.col("ts")),
        "occurred_source": F.when(has, "mtime").otherwise("event"),
    })


def filter_paths(
    file_events: DataFrame, root: Column, globs: Sequence[str] = DEFAULT_IGNORE,
    producer: Producer = DEFAULT_PRODUCER,
) -> DataFrame:
    """File events that a recorder would watch."""
    return file_events.where(~is_ignored(root, F.col("path"), globs, producer.footprint))
