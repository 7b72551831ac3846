"""Approximate nearest neighbours by a permutation index.

The index is cut by row into blocks of bounded size.  Each block draws pivots from its
own rows, represents every row by its nearest pivots in order, and posts rows in the
pivots' inverted files.  A query reads the files of its own nearest pivots, ranks rows
by footrule distance between the orders, and the nearest of them are compared on the
original vectors.

No pivot's file is one group however many vectors stand next to it, nothing passes
through the driver, and vectors of different lengths lie in different blocks.  The
stated query set meets every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import runs
from ledgerlens.settings import settle

PIVOTS = 256
PREFIX = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
CANDIDATE_SHARE = 0.25
LEAST_CANDIDATES = 256
#: Scores nearer than this are compared again, each row summed in the same order.
ROUNDING = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, dims, v``: every row that takes part, numbered; v as doubles.

    Rows without id, null or empty vectors, and vectors with null, non-finite or only
    zero components take no part.  Rows with one id are rows of their own.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    ).where(~bad & F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dims"), "v")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(matrix.ravel()))


def in_range(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which changes no cosine, so that no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first."""
    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    return np.argsort(-(x @ unit.T), axis=1, kind="stable")[:, :prefix]


def build_index(rows: DataFrame, blocks: int, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """``block, dims, row, vec_id, v, near, pivot``: rows by block, with their nearest pivots in order.

    ``pivot`` numbers the rows that are pivots of their block: distinct vectors, drawn
    by hash of the id.  ``v`` is brought into range.
    """
    cut = rows.select(
        F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), "dims", "row", "vec_id", "v",
        F.xxhash64("vec_id", F.lit(11)).alias("draw"),
    ).repartition("block", "dims").sortWithinPartitions("block", "dims", "draw", "vec_id", "row")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["block", "dims"]):
            x = in_range(_matrix(group.column("v")))
            drawn = np.sort(np.unique(x, axis=0, return_index=True)[1])[:pivots]
            number = np.full(len(x), -1, dtype=np.int16)
            number[drawn] = np.arange(len(drawn))
            made = [_lists(x), _lists(orders(x, x[drawn], prefix).astype(np.int16)), pa.array(number)]
            held = [group.column(c).combine_chunks() for c in ("block", "dims", "row", "vec_id")]
            yield pa.RecordBatch.from_arrays([*held, *made], ["block", "dims", "row", "vec_id", "v", "near", "pivot"])

    return cut.mapInArrow(
        order, "block int, dims int, row bigint, vec_id bigint, v array<double>, near array<smallint>, pivot smallint"
    )


def search_block(rows, ids, x, near, query_rows, q, query_near, pivots: int, k: int, share: float):
    """``(query, candidate, score)`` of the ``k`` best of one index block for each query, by the block's inverted files."""
    n, m = near.shape
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    posted, ranks = order // m, order % m
    bounds = np.searchsorted(flat[order], np.arange(pivots + 1))
    norms = np.sqrt((x * x).sum(axis=1))
    want = min(n, max(LEAST_CANDIDATES, int(np.ceil(share * n))))
    place = np.arange(m)
    for own, (number, vector, nearest) in enumerate(zip(query_rows, q, query_near)):
        if want < n:
            # Half the footrule with absent pivots at rank m, less what no inverted file touches.
            files = [slice(bounds[p], bounds[p + 1]) for p in nearest]
            r = np.repeat(place, bounds[nearest + 1] - bounds[nearest])
            less = m - np.maximum(np.concatenate([ranks[f] for f in files]), r)
            closeness = np.bincount(np.concatenate([posted[f] for f in files]), weights=less, minlength=n)
            cut = np.partition(closeness, n - want)[n - want]
            candidates = np.flatnonzero(closeness >= cut)
        else:
            candidates = np.arange(n)
        candidates = candidates[rows[candidates] != number]
        length = np.sqrt((vector * vector).sum())
        if len(candidates) > k:
            rough = (x[candidates] @ vector) / (norms[candidates] * length)
            candidates = candidates[rough >= np.partition(rough, -k)[-k] - ROUNDING]
        # Every row is summed in the same order, so that equal vectors tie exactly.
        score = (x[candidates] * vector).sum(axis=1) / (norms[candidates] * length)
        for b in np.lexsort((ids[candidates], -score))[:k]:
            yield own, int(ids[candidates[b]]), float(score[b])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, share: float = CANDIDATE_SHARE, pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, largest cosine first.

    ``share`` of each block is compared exactly (ties of the footrule cut included, and
    ``LEAST_CANDIDATES`` rows at least); it trades time for recall and is the same for
    every size.  Ties go to the smaller id.  A vector is searched among those of its own
    length.  Of rows with one id each query is answered, and each of the others is a
    candidate.  A query without candidates has no rows, and an empty table gives none;
    other columns are ignored.
    """
    rows = settle(usable(vectors), "ann-vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    index = settle(build_index(rows, blocks, pivots), "ann-index")
    queries = index.where(is_query)
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = index.select(
        "block", "dims", every(parts).alias("part"), F.lit(0).alias("side"), "row", "vec_id", "v", "near", "pivot"
    ).unionByName(queries.select(
        every(blocks).alias("block"), "dims", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("side"), "row", "vec_id", "v", F.lit(None).cast("array<smallint>").alias("near"),
        F.lit(-1).cast("smallint").alias("pivot"),
    )).repartition("block", "dims", "part").sortWithinPartitions("block", "dims", "part", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["block", "dims", "part"]):
            n = int((group.column("side").combine_chunks().to_numpy() == 0).sum())
            if not n or n == group.num_rows:
                continue
            number, ids, pivot = (group.column(c).combine_chunks().to_numpy() for c in ("row", "vec_id", "pivot"))
            x, near = _matrix(group.column("v")), _matrix(group.column("near").slice(0, n)).astype(np.int64)
            drawn = np.argsort(pivot[:n], kind="stable")[int((pivot[:n] < 0).sum()):]
            found = list(search_block(
                number[:n], ids[:n], x[:n], near, number[n:], x[n:], orders(x[n:], x[drawn], near.shape[1]), len(drawn), k, share
            ))
            if found:
                own, other, score = (np.array(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[n:][own]), pa.array(ids[n:][own]), pa.array(other), pa.array(score)],
                    ["row", "query_id", "vec_id", "score"],
                )

    found = both.mapInArrow(search, "row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
