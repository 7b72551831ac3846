"""Mixing sources to target weights: blocks, drawn source counts, permuted block indices.

Every source's documents are packed end to end and cut into blocks of a fixed number of
words.  The mix is a list of shards with the same number of slots.  How many slots of a
shard go to which source is drawn: every source gets the whole part of its expected number,
and what is left of the shard is a multinomial draw by the remaining parts, so that a source
meets its target within a few blocks however small the mix is.  Running sums of the counts
number the slots of a source through all shards; slot ``i`` takes the block at place ``i`` of
the source's pseudorandom permutation, and a source that is taken more than once runs
through its blocks again in another order.  Slots and blocks meet in one join by index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import DOCUMENT_COLUMNS, count_words, lean, narrow_batches
from ledgerlens.operators.ordered import attach, hash_salt
from ledgerlens.settings import settle

BLOCK_WORDS = 32
PASSES = 3
BUCKETS = 1024
SHARD_SLOTS = 4096
#: Shards that one row spells out at once.
CHUNK = 4096


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source")]


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, source, size`` of every row; a null text has no words."""
    return docs.select(*_key(), count_words("text").alias("size"))


def targets(rows: DataFrame, passes: int = PASSES) -> DataFrame:
    """One row per source: ``source_key, source_size, target, blocks, slots``.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  The level at
    which targets stop growing solves ``sum(min(passes * size, level * weight)) = total``:
    sources are tried in the order in which they reach their limit.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    per = per.withColumn("most", (F.col("source_size") * passes).cast("double"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumns({
        "level": (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        "at": F.row_number().over(by_limit),
    })
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("at"))
    per = per.withColumn("first", F.min(fits).over(whole))
    level = F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(whole)
    per = per.withColumn("target", F.least(F.col("most"), level * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("bigint")
    slots = F.least(blocks * passes, F.round(F.try_divide(F.col("target") * blocks, F.col("source_size"))).cast("bigint"))
    return per.select(
        "source", "source_size", "target", blocks.alias("blocks"),
        F.when(F.col("source_size") > 0, slots).otherwise(0).alias("slots"),
    )


def packed(rows: DataFrame) -> DataFrame:
    """Where every document starts in its source: running sums inside buckets plus the
    sums of earlier buckets, so a source that holds most rows is many small groups."""
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS))
    placed = rows.withColumn("bucket", bucket)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return joined.select(
        "doc_id", "text_hash", "source", "size", (F.col("base") + F.col("inside")).cast("bigint").alias("start")
    )


def _named(df: DataFrame) -> DataFrame:
    """Null sources under a key that joins: the null flag and the name."""
    return df.withColumns({"no_source": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})


def _uniform(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1) from a seed and the names of what it is for."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _left_over(live: DataFrame, slots: int, last: bool) -> tuple[DataFrame, int]:
    """How a shard of ``slots`` slots is shared out: whole parts, and the ranges of what is left.

    ``whole`` is a source's sure slots; a number in ``[low, high)`` of the ``left`` units of
    remaining parts falls to it.  One row per source and unit that its range touches.
    """
    expected = F.col("share") * slots
    order = Window.orderBy("no_source", "source")
    rows = live.withColumns({"last": F.lit(last), "whole": F.floor(expected).cast("bigint")})
    rows = rows.withColumn("high", F.sum(expected - F.col("whole")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("low", F.lag("high", 1, 0.0).over(order))
    left = slots - rows.agg(F.sum("whole")).first()[0]
    # The end of the last range takes what rounding left open.
    end = F.when(F.lead("high").over(order).isNull(), F.lit(left + 1.0)).otherwise(F.col("high"))
    return rows.withColumn("high", end), left


def drawn_counts(per: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``no_source, source, shard, count``: slots of every source in every shard, where it has any."""
    live = _named(per).where(F.col("slots") > 0)
    total = live.agg(F.sum("slots")).first()[0] or 0
    spark = per.sparkSession
    shards = -(-total // shard_slots)
    live = settle(live.withColumn("share", F.col("slots") / F.lit(float(total or 1))), "mix-shares")
    parts = []
    for last, first, count, slots in ((False, 0, shards - 1, shard_slots), (True, shards - 1, min(shards, 1), total - (shards - 1) * shard_slots)):
        if count <= 0:
            continue
        shared, left = _left_over(live, slots, last)
        chunk = F.explode(F.sequence(F.lit(0), F.lit((count - 1) // CHUNK)))
        sure = shared.where(F.col("whole") > 0).select("no_source", "source", F.col("whole").alias("count"), chunk.alias("chunk"))
        low = F.lit(first).cast("bigint") + F.col("chunk") * CHUNK
        spelled = sure.repartition("no_source", "source", "chunk").select(
            "no_source", "source", F.explode(F.sequence(low, F.least(low + CHUNK, F.lit(first + count)) - 1)).alias("shard"), "count"
        )
        parts.append(spelled)
        if left > 0:
            draws = spark.range(first, first + count).select(
                F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("draw")
            ).withColumn("at", _uniform(F.lit(seed), F.col("shard"), F.col("draw")) * left)
            units = shared.where(F.col("high") > F.col("low")).select(
                "no_source", "source", "low", "high",
                F.explode(F.sequence(F.floor("low"), F.greatest(F.floor("low"), F.ceil("high") - 1))).alias("unit"),
            )
            fell = draws.withColumn("unit", F.floor("at")).join(units, "unit").where(
                (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
            )
            parts.append(fell.select("no_source", "source", "shard", F.lit(1).cast("bigint").alias("count")))
    if not parts:
        return live.select("no_source", "source", F.lit(0).cast("bigint").alias("shard"), F.col("slots").alias("count"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("no_source", "source", "shard").agg(F.sum("count").alias("count"))


def permuted(n: np.ndarray, key: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Place ``i`` of the permutation of ``0 .. n-1`` that ``key`` names, for whole arrays.

    Four rounds on a pair of digits whose ranges hold hardly more than ``n`` numbers; what
    falls outside goes round again, so every number below ``n`` comes up once.
    """
    n, x = n.astype(np.int64), i.astype(np.int64).copy()
    wide = np.maximum(np.ceil(np.sqrt(n)).astype(np.int64), 1)
    high = -(-n // wide)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            w, h, k = wide[todo], high[todo], key[todo].astype(np.uint64)
            a, b = x[todo] // w, x[todo] % w
            for turn in range(4):
                seen = (b if turn % 2 == 0 else a).astype(np.uint64)
                mix = (seen + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k
                mix = (mix ^ (mix >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mix = (mix ^ (mix >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                step = (mix >> np.uint64(2)).astype(np.int64)
                if turn % 2 == 0:
                    a = (a + step % h) % h
                else:
                    b = (b + step % w) % w
            x[todo] = a * w + b
            todo = todo[x[todo] >= n[todo]]
    return x


@F.pandas_udf(T.LongType())
def _permuted(n: pd.Series, key: pd.Series, i: pd.Series) -> pd.Series:
    return pd.Series(permuted(n.to_numpy(), key.to_numpy(), i.to_numpy()))


def slots_of(per: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS, passes: int = PASSES) -> DataFrame:
    """``shard, place, no_source, source, block, pass`` of every slot of the mix.

    Slots of a source beyond ``passes`` times its blocks, which a draw may ask for, stay empty.
    """
    counts = settle(drawn_counts(per, seed, shard_slots), "mix-counts")
    before = Window.partitionBy("no_source", "source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumns({
        "offset": F.coalesce(F.sum("count").over(inside), F.lit(0)), "slots": F.sum("count").over(Window.partitionBy("shard")),
    })
    blocks = _named(per).select("no_source", "source", "blocks")
    slot = attach(numbered, blocks, ["no_source", "source"], hash_salt("shard"), "inner").select(
        "shard", "no_source", "source", "blocks", "first", "offset", "slots",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("k"),
    ).withColumn("slot", F.col("first") + F.col("k")).where(F.col("slot") < F.col("blocks") * passes)
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("int")
    return slot.select(
        "shard", _permuted("slots", F.xxhash64(F.lit(seed), "shard"), F.col("offset") + F.col("k")).alias("place"),
        "no_source", "source", turn.alias("pass"),
        _permuted("blocks", F.xxhash64(F.lit(seed), "no_source", "source", turn), F.col("slot") % F.col("blocks")).alias("block"),
    )


def pieces(spans: DataFrame) -> DataFrame:
    """One row per document and block it lies in, with the words they share."""
    low, high = F.col("start"), F.col("start") + F.col("size")
    block = F.explode(F.sequence(
        F.floor(low / BLOCK_WORDS).cast("bigint"), F.floor((high - 1) / BLOCK_WORDS).cast("bigint")
    ))
    out = _named(spans.where(F.col("size") > 0)).withColumn("block", block)
    first = F.greatest(low, F.col("block") * BLOCK_WORDS)
    last = F.least(high, (F.col("block") + 1) * BLOCK_WORDS)
    return out.withColumns({"from": (first - low).cast("int"), "upto": (last - low).cast("int")})


def mix(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of documents, sources with their targets, and the written mix.

    The mix has one row per slot and document in it: ``shard, place`` (its place in the
    shard), ``no_source, source, block, pass`` and the document's words ``from .. upto``.
    """
    rows = settle(sized(docs), "mix-sizes")
    per = settle(targets(rows), "mix-targets")
    spans = settle(packed(rows), "mix-spans")
    # Written first: slots are spelled out from a few rows, and only a table tells Spark their size.
    slots = settle(slots_of(per, seed), "mix-slots")
    taken = slots.join(pieces(spans), ["no_source", "source", "block"])
    return spans, per, settle(taken, "mix")


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    ``taken`` is the number of the document's words in the written mix, repeats counted; no
    block is taken more than ``PASSES`` times.  A source misses its target by the draws for
    what is left of each shard, each of which has a variance below one block: with ``N``
    shards by some ``sqrt(N)`` blocks.  Null and empty texts take nothing, a null source is a
    source, repeated rows are packed one by one, an empty table gives no rows, other
    columns are ignored.  The same table and seed give the same mix.
    """
    spans, per, taken = mix(docs, seed)
    at = ["no_source", "source", "start", "doc_id", "size"]
    words = taken.groupBy(*at).agg(F.sum(F.col("upto") - F.col("from")).alias("taken"))
    none = _named(spans).select(*at, F.lit(0).cast("bigint").alias("taken"))
    sums = words.unionByName(none).groupBy(*at).agg(F.sum("taken").alias("taken"))
    goals = _named(per).select("no_source", "source", "source_size", "target")
    return attach(sums, goals, ["no_source", "source"], hash_salt("doc_id", "start")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_texts(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents: for every pass that takes words of a document, one row with
    those words, in order and with the white space that followed them.

    Columns are those of ``documents``; ``n_chars`` is counted anew.
    """
    narrow_batches(docs.sparkSession)
    _, _, taken = mix(docs, seed)
    cut = taken.groupBy(
        "doc_id", "text_hash", "start", "pass"
    ).agg(F.sort_array(F.collect_list(F.struct("from", "upto"))).alias("words"))
    wanted = cut.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(
        F.sort_array(F.collect_list(F.struct("start", "pass", "words"))).alias("rows")
    )
    texts = docs.select(*DOCUMENT_COLUMNS).withColumn("_h", F.xxhash64("text")).withColumn("_d", F.col("doc_id"))
    held = texts.dropDuplicates(["_d", "_h"]).join(
        wanted.withColumnsRenamed({"_d": "_d2", "_h": "_h2"}),
        F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")),
    ).select(*DOCUMENT_COLUMNS, F.explode("rows.words").alias("words"))
    schema = docs.select(*DOCUMENT_COLUMNS).schema

    def cut_texts(batches):
        import re

        import pyarrow as pa

        word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = []
            for text, words in zip(columns["text"], columns["words"]):
                raw = text.encode()
                ends = [m.span() for m in word.finditer(raw)]
                out.append(b"".join(raw[ends[w["from"]][0]:ends[w["upto"] - 1][1]] for w in words).decode())
            kept = {n: batch.column(n) for n in ("doc_id", "lang", "source")}
            made = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
            yield pa.RecordBatch.from_pydict({f.name: made.get(f.name, kept.get(f.name)) for f in schema})

    return held.select(*DOCUMENT_COLUMNS, "words").mapInArrow(lean(cut_texts), schema)
