"""Fuzzy search for short license notices.

A notice of ``m`` characters may be written with up to ``k`` edits.  It is split into
``k + 1`` pieces; whatever the edits are, one piece is left whole, so the places where some
piece stands exactly are all the candidates there are.  Around each candidate, spans of
whole words are verified by the regex library with a bound on the errors, which rises from
none, so the first that fits is the number of edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, lean, narrow_batches
from ledgerlens.llm.decontamination import words_of

# The phrases of the contract and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Short passages of public license texts, and labels for them.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
CHARS_PER_EDIT = 12


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    base: bool

    @property
    def edits(self) -> int:
        return len(self.text) // CHARS_PER_EDIT

    def pieces(self) -> list[tuple[int, str]]:
        """``k + 1`` pieces of nearly equal length with their offsets."""
        n = self.edits + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def notices(phrases=PHRASES, others=NOTICES) -> tuple[Notice, ...]:
    return (*(Notice(t, label, True) for t, label in phrases), *(Notice(t, label, False) for t, label in others))


class Finder:
    """All places of all notices in a text of words that are joined by single spaces."""

    def __init__(self, known: tuple[Notice, ...]) -> None:
        import ahocorasick
        import regex

        self.known = known
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(known):
            for offset, piece in notice.pieces():
                at.setdefault(piece, []).append((i, offset))
        for piece, uses in at.items():
            self.seeds.add_word(piece, (len(piece), uses))
        if at:
            self.seeds.make_automaton()
        self.within = [
            [regex.compile(f"(?:{regex.escape(n.text)}){{e<={e}}}") for e in range(1, n.edits + 1)] for n in known
        ]

    def _edits(self, i: int, text: str, low: int, high: int) -> int | None:
        """Edits between the notice and a span, None beyond its bound."""
        notice = self.known[i].text
        if text[low:high] == notice:
            return 0
        for e, pattern in enumerate(self.within[i], 1):
            if e >= abs(high - low - len(notice)) and pattern.fullmatch(text, low, high):
                return e
        return None

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``notice, start, end, edits`` of every span of whole words within a notice's edits.

        Of spans of one notice that overlap, only those with the fewest edits stay (ties:
        the earlier, then the shorter); exact places all stay.
        """
        if not self.known:
            return []
        spans: dict[tuple[int, int, int], int] = {}
        tried: set[tuple[int, int, int]] = set()
        for last, (size, uses) in self.seeds.iter(text):
            for i, offset in uses:
                k, length = self.known[i].edits, len(self.known[i].text)
                start = last - size + 1 - offset
                for low in word_starts(text, start - k, start + k):
                    for high in word_ends(text, low + length - k, low + length + k):
                        if (i, low, high) not in tried:
                            tried.add((i, low, high))
                            e = self._edits(i, text, low, high)
                            if e is not None:
                                spans[i, low, high] = e
        found: list[tuple[int, int, int, int]] = []
        for (i, low, high), e in sorted(spans.items(), key=lambda s: (s[1], s[0][1], s[0][2])):
            if not e or not any(j == i and low < b and a < high for j, a, b, _ in found):
                found.append((i, low, high, e))
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def word_starts(text: str, low: int, high: int) -> list[int]:
    return [p for p in range(max(low, 0), min(high, len(text) - 1) + 1) if text[p] != " " and (p == 0 or text[p - 1] == " ")]


def word_ends(text: str, low: int, high: int) -> list[int]:
    n = len(text)
    return [p for p in range(max(low, 1), min(high, n) + 1) if text[p - 1] != " " and (p == n or text[p] == " ")]


@cache
def _finder(known: tuple[Notice, ...]) -> Finder:
    return Finder(known)


def search(docs: DataFrame, known: tuple[Notice, ...] = notices()) -> DataFrame:
    """``doc_id, n_words, places`` of every row; a place has ``notice, label, base, edits, similarity``,
    the first word and the word after the last one, in the order of the text.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered; null texts
    are empty.  A text without notices has no places, repeated rows and null ids are answered
    row by row, an empty table gives no rows, other columns are ignored.  Nothing is shuffled;
    a task holds one Arrow batch, of which a longer text is a part of its own.
    """
    narrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.struct([
        ("notice", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()),
        ("similarity", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(known)
        for batch in batches:
            counts, places = [], []
            for raw in as_bytes(pc.fill_null(batch.column(1), "")):
                words = words_of(raw)
                counts.append(len(words))
                places.append(list(placed(finder, b" ".join(words).decode())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place))], ["doc_id", "n_words", "places"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        lean(work),
        f"doc_id {kind}, n_words bigint, places array<struct<notice string, label string, base boolean, edits int, "
        "similarity double, first_word bigint, end_word bigint>>",
    )


def placed(finder: Finder, text: str) -> Iterator[dict]:
    told, word = 0, 0
    for i, low, high, e in finder.find(text):
        word += text.count(" ", told, low)
        told = low
        n = finder.known[i]
        yield {
            "notice": n.text, "label": n.label, "base": n.base, "edits": e, "similarity": 1.0 - e / len(n.text),
            "first_word": word, "end_word": word + text.count(" ", low, high) + 1,
        }


def _labels(places: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p.label))), ",")


def licenses(docs: DataFrame, known: tuple[Notice, ...] = notices()) -> DataFrame:
    """Per document: exact places of base phrases, their labels, labels of all notices found, and
    as ``score`` the similarity of the best place (0 without one)."""
    found = search(docs, known)
    base = F.filter("places", lambda p: p.base & (p.edits == 0))
    starts = F.transform(base, lambda p: p.first_word)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.similarity)), F.lit(0.0)).alias("score"),
    )
