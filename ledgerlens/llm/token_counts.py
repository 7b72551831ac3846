"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import narrow_batches
from ledgerlens.llm.tokens import Counter, encoder

GROUP_BYTES = 2 << 20


def balanced(texts: list[str], limit: int = GROUP_BYTES) -> Iterator[list[str]]:
    """Consecutive texts in groups of about ``limit`` characters; a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, as the library counts the whole text.

    For tokenizers that drop white space.  Null text counts as empty; ids may be null
    or repeat, each row is answered; other columns are ignored.
    """
    narrow_batches(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(Counter, tokenizer)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            counts: list[int] = []
            for group in balanced(text.to_pylist()):
                counts += enc.counts(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    ids = docs.select("doc_id", "text")
    counted = ids.mapInArrow(lengths, f"doc_id {ids.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
