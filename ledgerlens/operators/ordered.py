"""Ordered operators whose groups stay bounded.

A session may hold a third of all rows, so no operator here sorts a whole key in
one task.  Rows are windowed inside ``(key, bucket)``; one small row per bucket
carries counts, last values and totals across buckets, and a join on
``(key, bucket)`` brings them back.  ``bucket`` must grow with the row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096


def seq_bucket(seq: str = "seq") -> Column:
    return F.floor(F.col(seq) / F.lit(BUCKET_ROWS)).cast("bigint")


def hash_salt(*cols: str, parts: int = 64) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("bigint")


def ordered_view(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    position: str | None = None,
    lags: Mapping[str, str] | None = None,
    totals: Mapping[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Add a 1-based position, previous values and per-key totals to every row.

    ``lags`` maps a new column to the column whose previous value it holds.
    ``totals`` maps a new column to ``(aggregate over a bucket, combine)`` where
    combine is one of ``min``, ``max`` or ``sum``.

    Every row comes back: null keys are a key of their own, and rows whose order or
    bucket is null stand last in their key.
    """
    lags, totals = dict(lags or {}), dict(totals or {})
    rows = df.withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]

    summary_aggs = [agg.alias(f"_t_{name}") for name, (agg, _) in totals.items()]
    if position:
        summary_aggs.append(F.count(F.lit(1)).alias("_n"))
    if lags:
        last = F.struct(*[F.col(c).alias(f"_l_{new}") for new, c in lags.items()])
        summary_aggs.append(F.max_by(last, F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])).alias("_last"))
    summary = rows.groupBy(*group).agg(*summary_aggs)

    across = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = [F.col(c).alias(f"_g_{c}") for c in group]
    if position:
        carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if lags:
        carried.append(F.lag("_last").over(across).alias("_carry"))
    for name, (_, combine) in totals.items():
        carried.append(getattr(F, combine)(f"_t_{name}").over(whole).alias(name))
    summary = summary.select(*carried)

    local = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    if position or lags:
        rows = rows.withColumn("_rank", F.row_number().over(local))
        for new, c in lags.items():
            rows = rows.withColumn(f"_p_{new}", F.lag(c).over(local))
    out = rows.join(summary, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]))
    added = [F.col(c) for c in df.columns]
    if position:
        added.append((F.col("_offset") + F.col("_rank")).alias(position))
    for new in lags:
        added.append(
            F.when(F.col("_rank") == 1, F.col(f"_carry._l_{new}"))
            .otherwise(F.col(f"_p_{new}"))
            .alias(new)
        )
    added += [F.col(name) for name in totals]
    return out.select(*added)


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    salt: Column,
    how: str = "left",
) -> DataFrame:
    """Join one row per key onto many rows per key without one task per key.

    The small side is first spread over the ``(key, salt)`` pairs that exist, so
    the join on ``(key, salt)`` splits a hot key into as many tasks as it has salts.
    """
    rows = df.withColumn("_salt", salt)
    spread = rows.select(*keys, "_salt").distinct().join(per_key, list(keys), "inner")
    return rows.join(spread, [*keys, "_salt"], how).drop("_salt")
