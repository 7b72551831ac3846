"""Benchmark decontamination with a generalised suffix automaton.

The benchmark is the small side: its items are cut into pieces, the pieces into blocks
of bounded size, and one automaton is built per block.  Training texts stream through
the automata; the longest match that ends at each word tells which words are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import DOCUMENT_COLUMNS, as_bytes, lean, narrow_batches

WINDOW = 10
PIECE_WORDS = 4096
BLOCK_BYTES = 8 << 20
# Words are runs of 0-9, a-z (after lowering A-Z) and bytes beyond ASCII.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences, with the items of every window."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.marks: list[tuple[list[bytes], str | None]] = []

    def add(self, words: list[bytes], item: str | None) -> None:
        last = 0
        for w in words:
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        self.marks.append((words, item))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def finish(self) -> "Automaton":
        """Note at which states windows end, and of which items; short items are windows themselves."""
        self.ends: dict[int, dict[int, set]] = {}
        for words, item in self.marks:
            state = matched = 0
            size = min(self.window, len(words))
            for w in words:
                state = self.next[state][self.vocabulary[w]]
                matched += 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= size:
                    self.ends.setdefault(state, {}).setdefault(size, set()).add(item)
        self.marks = []
        # The nearest state with ends among a state and its suffixes, and the next after that.
        n = len(self.length)
        self.noted = [-1] * n
        for state in sorted(range(n), key=self.length.__getitem__):
            self.noted[state] = state if state in self.ends else (self.noted[self.link[state]] if state else -1)
        self.shortest = min((s for e in self.ends.values() for s in e), default=0)
        return self

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged hit ranges ``[start, end)`` over the words, and the items with occurring windows."""
        nxt, link, length, noted, ends, least = self.next, self.link, self.length, self.noted, self.ends, self.shortest
        found: list[list[int]] = []
        items: set = set()
        seen: set[int] = set()
        if not least:
            return found, items
        state = matched = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = matched = 0
                continue
            t = nxt[state].get(c)
            while t is None:
                state = link[state]
                matched = length[state]
                t = nxt[state].get(c)
            state = t
            matched += 1
            if matched < least:
                continue
            hit = 0
            v = noted[state]
            while v > 0:
                for size, of in ends[v].items():
                    if size <= matched:
                        # Inside one item's match of more than a window every word is hit.
                        hit = max(hit, size)
                        if (v, size) not in seen:
                            seen.add((v, size))
                            items |= of
                v = noted[link[v]]
            if hit:
                start = i + 1 - hit
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append([start, i + 1])
        return found, items


def merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted([*a, *b]):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def item_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """Items as pieces that overlap by a window less one word, so no window is lost and no
    piece is large, however long an item is."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                for start in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    if words:
                        ids.append(item)
                        parts.append(b" ".join(words[start:start + PIECE_WORDS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.string())], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    return rows.mapInArrow(lean(cut), "item string, words string")


def automata(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> list:
    """One broadcast automaton per block of pieces; blocks are collected one at a time and
    hold about ``block_bytes`` each, whatever the benchmark's size."""
    spark = benchmark.sparkSession
    pieces = item_pieces(benchmark, window)
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    out = []
    for b in range(blocks):
        rows = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        built = Automaton(window)
        for item, words in rows.distinct().collect():
            built.add(words.encode().split(), item)
        out.append(spark.sparkContext.broadcast(built.finish()))
    return out


def find(held: list, words: list[bytes]) -> tuple[list[list[int]], set]:
    """Hit ranges and items by all of the broadcast automata."""
    ranges, of = held[0].value.match(words)
    for other in held[1:]:
        more, also = other.value.match(words)
        ranges, of = merge(ranges, more), of | also
    return ranges, of


def match_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (columns of documents) with ``n_words``, ``spans`` (hit word
    ranges) and ``items`` (ids with occurring windows).

    A null or empty text has no words and no hits.  Items with null ids hit, but are not
    listed; items without words are no windows; repeated items count once.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    columns = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    rows = docs.select(*columns)
    held = automata(benchmark, window)
    at = columns.index("text")
    schema = rows.select(
        "*", F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    ).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = [], [], []
            for text in as_bytes(batch.column(at)):
                words = words_of(text)
                ranges, of = find(held, words)
                counts.append(len(words))
                spans.append(ranges)
                items.append(sorted(i for i in of if i is not None))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                 pa.array(items, pa.list_(pa.string()))], [f.name for f in schema],
            )

    return rows.mapInArrow(lean(stream), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    found = match_documents(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + F.element_at(s, 2) - F.element_at(s, 1))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5,
) -> DataFrame:
    """Documents without benchmark spans.

    Hit spans of ``min_span`` words or more are cut out of the text; a document whose hit
    words are more than ``max_coverage`` of its words goes.  Columns are those of
    documents, ``n_chars`` counted anew where a text changed.
    """
    narrow_batches(docs.sparkSession)
    held = automata(benchmark, window)
    rows = docs.select(*DOCUMENT_COLUMNS)
    at, chars_at = DOCUMENT_COLUMNS.index("text"), DOCUMENT_COLUMNS.index("n_chars")
    schema = rows.schema

    # One function matches and cuts, so a task needs one Python worker.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, chars = [], [], []
            for text, n in zip(as_bytes(batch.column(at)), batch.column(chars_at).to_pylist()):
                words = words_of(text)
                spans, _ = find(held, words)
                keep.append(sum(high - low for low, high in spans) <= max_coverage * len(words))
                if not keep[-1]:
                    continue
                drop = [s for s in spans if s[1] - s[0] >= min_span]
                if drop:
                    text = without(text, drop)
                    n = len(text.decode())
                texts.append(text)
                chars.append(n)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            columns = list(kept.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns[chars_at] = pa.array(chars, pa.int64()).cast(kept.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, list(DOCUMENT_COLUMNS))

    return rows.mapInArrow(lean(cut), schema)


def without(raw: bytes, spans: list[list[int]]) -> bytes:
    """The UTF-8 text without the words of ``spans`` and what stands between those words."""
    shown = raw.translate(_WORDS)
    starts, ends, at = [], [], 0
    for w in shown.split():
        at = shown.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, done = [], 0
    for low, high in spans:
        out.append(raw[done:starts[low]])
        done = ends[high - 1]
    out.append(raw[done:])
    return b"".join(out)
