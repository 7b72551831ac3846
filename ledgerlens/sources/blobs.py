"""Content snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.paths import is_sensitive_path
from ledgerlens.sources.files import files_below, read_in_turns


def looks_binary(content: Column, probe: int | None = None) -> Column:
    """A NUL byte in the content, or among its first ``probe`` bytes."""
    head = content if probe is None else F.substring(content, 1, probe)
    return F.position(F.lit(b"\x00"), head) > 0


def blob_manifest(
    spark: SparkSession, path: str, max_bytes: int | None = None, files: DataFrame | None = None,
) -> DataFrame:
    """``path, bytes, ref, binary, oversized, sensitive`` of every file.

    No digest is taken of credential-shaped files, nor of files above ``max_bytes`` where a
    bound is given; the latter are not read.  ``files`` is a listing made before; without
    one, folders are listed in turns.
    """
    if files is None:
        return read_in_turns(spark, path, lambda some: blob_manifest(spark, path, max_bytes, some), "blob-manifest")
    stamp = F.unix_millis("modificationTime").cast("double")
    open_ = ~is_sensitive_path(F.col("path"))
    manifest = lambda df, ref, binary, oversized: df.select(
        "path", F.col("length").alias("bytes"), stamp.alias("mtime_ms"), ref.alias("ref"), binary.alias("binary"),
        oversized.alias("oversized"), (~open_).alias("sensitive"),
    )
    fits = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    read = manifest(
        fits, F.when(open_, F.sha2("content", 256)), F.coalesce(open_ & looks_binary(F.col("content")), F.lit(False)), F.lit(False)
    )
    if max_bytes is None:
        return read
    large = files.where(F.col("length") > max_bytes)
    return read.unionByName(manifest(large, F.lit(None).cast("string"), F.lit(False), open_))


def blob_table(
    spark: SparkSession, path: str, max_bytes: int | None = None, files: DataFrame | None = None,
) -> DataFrame:
    """Distinct contents: ``ref, length, content``; without a listing, folders are read in turns and contents are kept."""
    if files is None:
        turns = read_in_turns(spark, path, lambda some: blob_table(spark, path, max_bytes, some), "blob-table", texts=True)
        return turns.dropDuplicates(["ref"])
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    kept = files.where(~is_sensitive_path(F.col("path")) & small)
    return kept.select(
        F.sha2("content", 256).alias("ref"), "length", "content"
    ).dropDuplicates(["ref"])
