"""Token ids as Parquet list columns, in id order, for selective reads.

Layout of a dataset: ``doc_id, n_tokens, part, row, ids array<int>``.  Ids are dictionary
encoded (a vocabulary fits one dictionary page), row groups and pages are small and
carry indexes, so a reader fetches the rows of an id range, or the counts alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import gathered, give_back, lean, narrow_batches
from ledgerlens.llm.tokens import SpaceEncoder, encoder
from ledgerlens.settings import checkpoint_root

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 1 << 20
# Words repeat more in a larger group of texts; its ids leave in smaller batches.
GROUP_BYTES = 6 << 20
OUT_ROWS = 1024


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Ids of every whole text with ``end_id`` after it; the partition's number goes along."""
    narrow_batches(docs.sparkSession)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(SpaceEncoder, tokenizer), TaskContext.get().partitionId()
        done = 0
        for group in gathered(batches, GROUP_BYTES):
            ids = enc.ids(pc.fill_null(group.column(1), ""), end_id)
            n = len(ids)
            coded = pa.RecordBatch.from_arrays(
                [group.column(0), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)),
                 pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(done, done + n, dtype=np.int64)), ids],
                ["doc_id", "n_tokens", "part", "row", "ids"],
            )
            yield from (coded.slice(i, OUT_ROWS) for i in range(0, n, OUT_ROWS))
            done += n
            del group, ids, coded
            give_back()

    rows = docs.select("doc_id", "text")
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(lean(ids_of), f"doc_id {kind}, n_tokens bigint, part int, row bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write all documents in ascending id order (nulls first, repeated ids by text)."""
    tie = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    )
    (
        encode(ordered, tokenizer, end_id).write
        .option("compression", "zstd")
        .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_id: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {doc_id}, n_tokens bigint, part int, row bigint, ids array<int>").parquet(path)


def digest(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read from the files.

    Starts are running sums inside a part plus the sums of the parts before it, so
    no task holds more than one part's counts (and one row per part).
    """
    kind = stored.schema["doc_id"].dataType.simpleString()

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            crc = [zlib.crc32(np.ascontiguousarray(values[a:b], dtype="<i4")) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    narrow_batches(stored.sparkSession)
    rows = stored.select("doc_id", "part", "row", "ids").mapInArrow(
        lean(checksums), f"doc_id {kind}, part int, row bigint, n_tokens bigint, ids_crc32 bigint"
    )
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "part").select(
        "doc_id", (F.col("base") + F.col("inside")).cast("bigint").alias("start"), "n_tokens", "ids_crc32"
    )


def store_and_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a new folder of the shared directory and answer from what was written.

    Null text is empty (the end id alone); an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_root(spark)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return digest(read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString()))
