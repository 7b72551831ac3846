"""Quality by ordinal cumulative-link regression over hashed text features.

Ratings are grades 0 < 1 < 2.  One weight vector ``w`` over hashed features serves all
grades and ordered thresholds cut its score: ``P(grade <= k) = logistic(t_k - w.x)``.
A document gets its expected grade and its tail probability ``P(grade >= 2)``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import DOCUMENT_COLUMNS, lean, narrow_batches
from ledgerlens.settings import settle

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 12_000
GRADES = 3
MIN_TAIL = 0.4
MIN_DOCUMENTS = 8
MIN_SIGNAL = 2.5
STEPS = 300
MEMO = 200_000
_EDGES = ".,;:!?%$*#&|\"'()[]{}<>=+-_/\\~^@`"
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+")
_ANY = re.compile(r"[^\W\d_A]+")
_DIGITS = re.compile(r"\d+")
_REPEAT = re.compile(r"(.)\1+")
_DROP_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_DROP_SIGNS = bytes(b for b in range(256) if not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126))
_DROP_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def _hash(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) % DIMENSIONS


def word_features(word: str) -> tuple[int, ...]:
    """Features of one token: its shape, and beginnings and whole of its lower-cased core."""
    shape = _REPEAT.sub(r"\1\1", _ANY.sub("a", _DIGITS.sub("0", _UPPER.sub("A", word))))[:12]
    out = [_hash("s", shape)]
    core = word.strip(_EDGES).lower()
    if core:
        out += [_hash(f"p{k}", core[:k]) for k in (4, 5) if len(core) >= k]
        if len(core) not in (4, 5):
            out.append(_hash("w", core))
    return tuple(out)


def _step(share: float) -> int:
    return 0 if share <= 0 else max(1, 8 + int(np.floor(np.log2(share))))


def text_features(text: str, words: list[str], distinct: set[str]) -> list[int]:
    """Features of the whole text: shares of capitals, signs, digits and repeats, in powers of two."""
    raw = text.encode()
    n, size = max(1, len(words)), max(1, len(raw))
    again = sum(map(str.__eq__, words, words[1:]))
    shares = {
        "caps": len(raw.translate(None, _DROP_UPPER)) / size, "signs": len(raw.translate(None, _DROP_SIGNS)) / size,
        "digits": len(raw.translate(None, _DROP_DIGITS)) / size, "again": again / n,
    }
    out = [_hash("t", f"{k}{_step(v)}") for k, v in shares.items()]
    out.append(_hash("t", f"new{int(8 * len(distinct) / n)}/{min(12, n.bit_length())}"))
    return out


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, 1 poor, 2 good; the lowest where a document was rated twice."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(
        F.min("grade").alias("grade")
    )


def sample(rated: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rated documents, chosen by hash of the id; all of them where there are fewer."""
    total = rated.count()
    if total <= rows:
        return rated
    return rated.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def feature_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, grade, features`` of the chosen documents; the sample's size bounds the broadcast."""
    narrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.split()
                distinct = set(words)
                found = set(text_features(text, words, distinct))
                for w in distinct:
                    found.update(word_features(w))
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(out, pa.list_(pa.int32()))],
                ["doc_id", "grade", "features"],
            )

    return rows.mapInArrow(lean(make), "doc_id bigint, grade int, features array<int>")


def _logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_arrays(y: np.ndarray, rows: list[np.ndarray], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features kept, their weights and the thresholds.

    A feature stays if it occurs in enough documents and its share differs between one
    grade and the others by more than chance; full-batch Adam minimises the likelihood.
    """
    n = len(y)
    ids = np.concatenate(rows) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    seen = np.bincount(ids, minlength=DIMENSIONS).astype(float)
    signal = np.zeros(DIMENSIONS)
    for k in range(GRADES):
        m = int((y == k).sum())
        if not 0 < m < n:
            continue
        own = np.bincount(ids[y[owner] == k], minlength=DIMENSIONS)
        share = seen / n
        error = np.sqrt(share * (1 - share) * (1 / m + 1 / (n - m)) + 1e-12)
        signal = np.maximum(signal, np.abs(own / m - (seen - own) / (n - m)) / error)
    kept = np.flatnonzero((seen >= min(MIN_DOCUMENTS, max(1, n // 20))) & (seen < n) & (signal > MIN_SIGNAL))
    place = np.full(DIMENSIONS, -1)
    place[kept] = np.arange(len(kept))
    col = place[ids]
    owner, col = owner[col >= 0], col[col >= 0]
    value = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))
    share = np.array([(y <= k).mean() if n else 0.5 for k in range(GRADES - 1)]).clip(0.01, 0.99)
    t = np.maximum.accumulate(np.log(share / (1 - share)))
    w = np.zeros(len(kept))
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    at = np.arange(n)
    for step in range(1, steps + 1 if n else 0):
        s = np.bincount(owner, w[col], n) * value
        cum = np.column_stack([np.zeros(n), *(_logistic(x - s) for x in t), np.ones(n)])
        slope = cum * (1 - cum)
        p = np.maximum(cum[at, y + 1] - cum[at, y], 1e-9)
        upper, lower = slope[at, y + 1] / p, slope[at, y] / p
        g = np.bincount(col, ((upper - lower) * value)[owner], len(w)) / n + 1e-5 * w
        gt = np.array([(lower[y == k + 1].sum() - upper[y == k].sum()) / n for k in range(len(t))])
        rate = 0.3 * min(1.0, (steps + 1 - step) / 100)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        t1, t2 = 0.9 * t1 + 0.1 * gt, 0.999 * t2 + 0.001 * gt * gt
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        t -= rate * (t1 / (1 - 0.9**step)) / (np.sqrt(t2 / (1 - 0.999**step)) + 1e-8)
        t = np.maximum.accumulate(t)
    return kept, w, t


def fit(docs: DataFrame, rated: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The model as rows ``feature, weight``; thresholds are features below 0.

    One task fits it, on a sample that ``rows`` bounds; the model has at most
    ``DIMENSIONS`` weights.
    """
    made = feature_rows(docs, settle(sample(rated, rows), "quality-sample"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.to_pydict() for b in batches]
        flat = sorted(zip(*(sum((p[c] for p in parts), []) for c in ("doc_id", "grade", "features"))))
        y = np.array([r[1] for r in flat], dtype=np.int64)
        kept, w, t = fit_arrays(y, [np.array(r[2], dtype=np.int64) for r in flat])
        yield pa.RecordBatch.from_arrays(
            [pa.array([*kept.tolist(), *range(-len(t), 0)], pa.int32()), pa.array([*w.tolist(), *t.tolist()], pa.float64())],
            ["feature", "weight"],
        )

    # One sort key: all rows of the bounded sample meet in one task.
    return settle(made.repartition(1).mapInArrow(lean(train), "feature int, weight double"), "quality-model")


def score(docs: DataFrame, model: DataFrame, min_tail: float = MIN_TAIL) -> DataFrame:
    """Columns of documents with ``expected_grade``, ``tail_probability`` and ``kept``.

    Every row is scored, its whole text read; a null or empty text has the features of an
    empty text.  ``kept`` is the selection: tail probability of ``min_tail`` or more.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    columns = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    rows = docs.select(*columns)
    at = columns.index("text")
    weights = {r.feature: r.weight for r in model.collect()}  # at most DIMENSIONS numbers
    shared = spark.sparkContext.broadcast(weights)
    schema = rows.select(
        "*", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability"), F.lit(True).alias("kept")
    ).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        t = np.array([w[k] for k in sorted(k for k in w if k < 0)])
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            expected, tail = [], []
            for text in batch.column(at).to_pylist():
                text = text or ""
                words = text.split()
                distinct = set(words)
                found = {f for f in text_features(text, words, distinct) if f in w}
                if len(memo) > MEMO:
                    memo.clear()
                for word in distinct:
                    f = memo.get(word)
                    if f is None:
                        f = memo[word] = tuple(x for x in word_features(word) if x in w)
                    if f:
                        found.update(f)
                s = sum(map(w.__getitem__, found)) / max(1, len(found)) ** 0.5
                above = 1 - _logistic(t - s)
                expected.append(float(above.sum()))
                tail.append(float(above[-1]))
            keep = [p >= min_tail for p in tail]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(keep, pa.bool_())],
                [f.name for f in schema],
            )

    return rows.mapInArrow(lean(predict), schema)


def rate(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, min_tail: float = MIN_TAIL) -> DataFrame:
    """Fit on the rated documents among ``docs`` and score all of them.

    Without any rating every document gets the thresholds' prior and none is preferred.
    """
    return score(docs, fit(docs, grades(labels), rows), min_tail)


def rate_table(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rate(docs.select("doc_id", "text"), labels).drop("text")
