"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_batches(spark: SparkSession, rows: int = 1024, size: str = "16m") -> None:
    """Let no Arrow batch hold more than ``rows`` rows or about ``size`` bytes, since one row may be a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def count_words(text: str) -> Column:
    """Number of runs without ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``keys`` into one table per key; only the group at hand is held."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i, row in enumerate(rows):
            if row != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, start = [], row, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """An Arrow function that gives memory back when its task ends, since its worker goes on to other tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            give_back()

    return run


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they reach about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


class Forest:
    """Union by smallest member, for the groups that one task holds."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def cluster(n: int, linked) -> list[int]:
    """Components of ``n`` members, where ``linked(i)`` gives the members that ``i`` is linked with.

    Links inside the largest component cannot change anything, so once every member
    outside it was asked, the answer is exact; a family of copies costs few questions.
    """
    forest = Forest(n)
    asked = [False] * n
    step = 1
    while True:
        roots = [forest.find(i) for i in range(n)]
        size: dict[int, int] = {}
        for r in roots:
            size[r] = size.get(r, 0) + 1
        most = max(size, key=lambda r: (size[r], -r))
        todo = [i for i in range(n) if not asked[i] and (roots[i] != most or size[most] == 1)]
        if not todo:
            return roots
        for i in todo[:step]:
            asked[i] = True
            for j in linked(i):
                forest.join(i, int(j))
        step *= 2
