"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period ``q`` that holds at least four periods
and cannot be extended.  Periods up to ``DIRECT`` are found by comparing the words with
themselves ``q`` further on.  Longer ones belong to a scale: at scale ``s``, for periods
in ``(s, 2 s]``, every ``2 s`` consecutive words have a fingerprint, and the smallest one
of every ``s`` places is a minimizer.  Inside a run the minimizers repeat at the distance
of the period, so neighbouring minimizers with equal fingerprints are the seeds that are
extended, word by word, to both sides.  Four periods are always enough for one such pair:
``s`` places, the ``2 s`` words of a fingerprint and the shift by one period are less.

The texts of a batch are laid end to end with a word of its own between them, so no run
crosses texts and the work is done on whole arrays.  Fingerprints have 64 bits, words are
compared by exact ids: a collision can hide a run (below ``n^2 / 2^64`` for ``n`` words of
a batch) and never make one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import gathered, lean, narrow_batches

DIRECT = 8
PERIODS = 4
LEAST_LENGTH = 6
GROUP_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and how many each text has; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[1:] = inside[1:] & ~inside[:-1]
    first[:1] = inside[:1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    places = np.concatenate([np.searchsorted(np.flatnonzero(inside), starts), [np.count_nonzero(inside)]])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data[inside])]
    )
    return words, counts


def planted(ids: list[int | None], counts: np.ndarray) -> np.ndarray:
    """Which original word stands at every place, once the texts that the ids name are made periodic."""
    base = np.concatenate([[0], np.cumsum(counts)])
    which = np.arange(base[-1])
    for key, low, n in zip(ids, base, counts.tolist()):
        if not n or key is None:
            continue
        h = zlib.crc32(str(key).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        which[low + a:low + n] = low + a + np.arange(n - a) % p
    return which


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    full[:n] = values
    rows = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of two fingerprints in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _reach(word: np.ndarray, i: int, lag: int, step: int) -> int:
    """How far from ``i``, in the direction of ``step``, words equal those ``lag`` further on."""
    n = len(word) - lag
    size, told = 64, 0
    while True:
        if step > 0:
            a = word[i + told:min(i + told + size, n)]
            same = a == word[i + told + lag:i + told + lag + len(a)]
        else:
            high = i - told + 1
            low = max(high - size, 0)
            same = (word[low:high] == word[low + lag:high + lag])[::-1]
        bad = np.flatnonzero(~same)
        if len(bad):
            return told + int(bad[0])
        told += len(same)
        if len(same) < size:
            return told
        size *= 2


def _direct(word: np.ndarray, period: int) -> np.ndarray:
    """``start, end`` of the stretches of this period that are long enough."""
    same = np.concatenate([[False], word[:-period] == word[period:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edges[:, 1] += period
    return edges[edges[:, 1] - edges[:, 0] >= max(LEAST_LENGTH, PERIODS * period)]


def find_runs(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, end, period`` of all runs in texts laid end to end, by start, then period.

    ``word`` holds ids below 2^62 of the texts' words, ``counts`` how many words each text has.
    """
    found: list[tuple[int, int, int]] = []
    # Texts end to end, each with a word of its own after it, and where every word stands.
    after = np.cumsum(counts) + np.arange(len(counts))
    inside = np.ones(len(word) + len(counts), bool)
    inside[after] = False
    at = np.cumsum(inside) - 1
    line = -1 - np.arange(len(inside))
    line[inside] = word
    left, low, prints = counts, 0, line.astype(np.uint64)
    while True:
        # Texts too short for any longer period go.
        keep = left >= max(PERIODS * (low + 1), LEAST_LENGTH)
        if not keep.any():
            break
        if not keep.all():
            mask = np.repeat(keep, left + 1)
            line, at, prints, left = line[mask], at[mask], prints[mask], left[keep]
        if low:
            stretches, prints = _scale(line, prints, low)
        else:
            stretches = [(s, e, q) for q in range(1, DIRECT + 1) if len(line) > q for s, e in _direct(line, q).tolist()]
            prints = _widened(_mixed(prints, np.uint64(0x2545F4914F6CDD1D) + np.zeros_like(prints)), 1, DIRECT)
        found += [(int(at[s]), int(at[e - 1]) + 1, q) for s, e, q in stretches]
        low = 2 * low or DIRECT
    # A stretch that also has a smaller period was found with that one, too, and counts once.
    least: dict[tuple[int, int], int] = {}
    for start, end, period in found:
        least[start, end] = min(period, least.get((start, end), period))
    return np.array(sorted((s, e, p) for (s, e), p in least.items()), np.int64).reshape(-1, 3)


def _widened(prints: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Fingerprints of ``wanted`` words from those of ``size``; the last places see fewer words."""
    while size < wanted:
        prints = np.concatenate([_mixed(prints[:-size], prints[size:]), prints[-size:]])
        size *= 2
    return prints


def _scale(line: np.ndarray, prints: np.ndarray, scale: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Stretches with a period in ``(scale, 2 scale]`` from pairs of equal minimizers, and the
    fingerprints of ``2 scale`` words that they were found with; ``prints`` has those of ``scale``."""
    prints = _widened(prints, scale, 2 * scale)
    smallest = _least(prints, scale)
    # A place is a minimizer if one of the windows around it has its fingerprint as smallest.
    none = np.full(scale - 1, ~np.uint64(0))
    largest = ~_least(np.concatenate([none, ~smallest, none]), scale)
    places = np.flatnonzero(largest == prints)
    order = places[np.argsort(prints[places], kind="stable")]
    lag = order[1:] - order[:-1]
    good = (prints[order[1:]] == prints[order[:-1]]) & (lag > scale) & (lag <= 2 * scale)
    starts, lag = order[:-1][good], lag[good]
    by = np.lexsort((starts, lag))
    starts, lag = starts[by], lag[by]
    found = []
    i = 0
    while i < len(starts):
        at, period = int(starts[i]), int(lag[i])
        upto = at + _reach(line, at, period, 1)
        if upto > at:
            start, end = at - _reach(line, at, period, -1) + 1, upto + period
            if end - start >= PERIODS * period:
                found.append((start, end, period))
        last = int(np.searchsorted(lag, period, "right"))
        i = max(i + 1, i + int(np.searchsorted(starts[i:last], upto)))
    return found, prints


def collapse(which: np.ndarray, words: pa.Array, counts: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Every text without the words that a run holds after its first period, joined by spaces."""
    change = np.zeros(len(which) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    base = np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([[0], np.cumsum(kept)])[base]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(which[kept])))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def scan(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: all runs of the whole text as
    ``start, length, period`` in words, and the text with each run cut to its first period.

    A null or empty text, or one of white space, has no runs and collapses to the empty
    text; repeated rows and null ids are answered row by row, an empty table gives no
    rows, other columns are ignored.  With ``plant`` one text in ten, chosen by its id, is
    made periodic before (a null id never is).  Nothing is shuffled: a task reads its texts
    in groups of about ``GROUP_BYTES``, and a longer text is a group of its own.
    """
    narrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            words, counts = split_words(batch.column(1))
            which = planted(batch.column(0).to_pylist() if plant else [None] * len(counts), counts)
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = find_runs(ids[which], counts)
            texts = collapse(which, words, counts, runs)
            base = np.concatenate([[0], np.cumsum(counts)])
            doc = np.searchsorted(base, runs[:, 0], "right") - 1
            listed = pa.StructArray.from_arrays(
                [pa.array(c, pa.int64()) for c in (runs[:, 0] - base[doc], runs[:, 1] - runs[:, 0], runs[:, 2])],
                ["start", "length", "period"],
            )
            offsets = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), listed), texts.cast(pa.large_string()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        lean(work), f"doc_id {kind}, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut into groups of about ``GROUP_BYTES`` of text."""
    for batch in gathered(batches, GROUP_BYTES):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        low = 0
        while low < batch.num_rows:
            told = ends[low - 1] if low else 0
            high = max(int(np.searchsorted(ends, told + GROUP_BYTES, "right")), low + 1)
            yield batch.slice(low, high - low)
            low = high


def summaries(found: DataFrame) -> DataFrame:
    """The runs of every row of ``scan`` as counts, the strongest run, and hashes."""
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def strength(run: dict) -> tuple[Fraction, int, int]:
        return Fraction(run["length"], run["period"]), -run["start"], -run["period"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for runs, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                best = max(runs, key=strength) if runs else None
                told = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rows.append((
                    len(runs),
                    *((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4),
                    hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
                ))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return found.mapInArrow(
        lean(work),
        f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string",
    )


def without_runs(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` collapsed where it has runs; other columns and rows stay as they are."""
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(c) for c in columns]).alias("doc_id"), F.col("text"))
    found = scan(row)
    cut = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc_id.text"))
    return found.select(*[cut.alias(c) if c == "text" else F.col("doc_id")[c].alias(c) for c in columns])
