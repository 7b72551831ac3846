"""Memoised batch encoding with the tokenizers library, exact for whole texts.

A text is cut only where the tokenizer's own pre-tokeniser always cuts, so the
tokens of the parts, one after the other, are the tokens of the text.  Each
distinct part is encoded once per group of texts or worker, in bounded memory.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_PARTS = 100_000
# Words whose ids a worker keeps from one group of texts to the next: some 50 bytes each.
MOST_PIECES = 500_000
BATCH_BYTES = 1 << 20
# What some version of Unicode has called white space, or may be taken for it.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200C))
)
_SAFE_SPACE = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
# Letters in every version of Unicode, before signs: two tokens of the pre-tokeniser.
_LETTER_SIGN = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([,.;:!?])"
_ENCODERS: dict[tuple, "Encoder"] = {}


def split_at_blanks(text: str) -> list[str]:
    """Parts for a tokenizer that drops white space: between spaces and line feeds."""
    return text.replace("\n", " ").split(" ")


class Encoder:
    """A tokenizer with a bounded memory of the parts it has encoded."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Parts are encoded once, so the library's own memory of words would only cost time.
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        self.known: dict = {}
        self.older: dict = {}

    def unknown(self, parts: set[str]) -> list[str]:
        """The parts that are to be encoded; those of the generation before come back."""
        known, older = self.known, self.older
        new = parts.difference(known)
        if not older:
            return list(new)
        known.update((p, older[p]) for p in new.intersection(older))
        return list(new.difference(older))

    def room(self) -> None:
        """Called between groups: a full memory becomes the older one."""
        if len(self.known) > MOST_PARTS:
            self.older, self.known = self.known, {}

    def encode(self, parts: list[str]) -> Iterator[list[int]]:
        """Ids of each part, in batches of about equal bytes."""
        start = 0
        while start < len(parts):
            end, size = start, 0
            while end < len(parts) and (end == start or size + len(parts[end]) < BATCH_BYTES):
                size += len(parts[end])
                end += 1
            for e in self.tokenizer.encode_batch_fast(parts[start:end], add_special_tokens=False):
                yield e.ids
            start = end


class Counter(Encoder):
    """Counts for tokenizers that drop white space."""

    def counts(self, texts: list[str]) -> list[int]:
        self.room()
        parts = [split_at_blanks(t) for t in texts]
        new = self.unknown(set().union(*parts))
        self.known.update(zip(new, map(len, self.encode(new))))
        known = self.known
        return [sum(map(known.__getitem__, p)) for p in parts]


class SpaceEncoder(Encoder):
    """Ids for byte-level BPE whose tokens take one leading space.

    A single space between two characters that are not white space always begins a
    token, a single line feed between two such characters is one, and letters never share
    a token with the signs after them.  So a plain text falls into pieces: words after a
    space, words after a line feed, and signs after a letter.  Arrow finds the distinct
    pieces of a group of texts, those that a worker does not hold from earlier groups are
    encoded as lines of a longer text, and the ids of the texts are gathered from both.  Texts with other white space or with
    special strings are cut at safe spaces only.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        special = "".join("|" + re.escape(str(a.content)) for a in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = rf"\A[{_WHITE}]|[{_WHITE}]\z|[ \n][{_WHITE}]|[{_WHITE}][ \n]" + special
        self.not_a_word = re.compile(rf"[{_WHITE}]" + special)
        self._hold(pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))

    def _hold(self, pieces: pa.Array, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.pieces, self.piece_ids, self.starts, self.lengths = pieces, ids, starts, lengths

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_lines`` of distinct pieces, of which only those not held from earlier groups are encoded.

        When more than ``MOST_PIECES`` are held, those of the group at hand alone stay.
        """
        pieces = pieces.cast(pa.string())
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(pc.is_null(at))
        ids, starts, lengths = self._lines(new)
        held = len(self.pieces)
        self._hold(
            pa.concat_arrays([self.pieces, new]), np.concatenate([self.piece_ids, ids]),
            np.concatenate([self.starts, starts + len(self.piece_ids)]), np.concatenate([self.lengths, lengths]),
        )
        index = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        index[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(held, held + len(new))
        ids, starts, lengths = self.piece_ids, self.starts[index], self.lengths[index]
        if len(self.pieces) > MOST_PIECES:
            if len(pieces) > MOST_PIECES:
                self._hold(self.pieces.slice(0, 0), *(a[:0].copy() for a in (ids, starts, lengths)))
            else:
                ends = np.cumsum(lengths)
                own = ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
                self._hold(pieces, own, ends - lengths, lengths)
        return ids, starts, lengths

    def _lines(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the pieces, with the start and the number of each piece's own.

        A piece that begins with a line feed keeps its id; carriage returns mark bare
        pieces; all others are words after a space.
        """
        fed, bare = pc.starts_with(pieces, "\n"), pc.starts_with(pieces, "\r")
        lines = pc.if_else(
            fed, pieces,
            pc.binary_join_element_wise(pc.if_else(bare, "\n", "\n "), pc.replace_substring_regex(pieces, "\\A\r", ""), ""),
        )
        cut = pc.cumulative_sum(pc.cast(pc.binary_length(lines), pa.int64())).to_numpy()
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "")[0].as_buffer()
        found: list[np.ndarray] = []
        start = 0
        while start < len(lines):
            done = cut[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cut, done + BATCH_BYTES // 8)))
            part = text.slice(done, cut[end - 1] - done).to_pybytes().decode()
            ids = self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids
            found.append(np.array(ids, dtype=np.int32))
            start = end
        ids = np.concatenate([np.empty(0, np.int32), *found])
        at = np.flatnonzero(ids == self.feed)
        if len(at) != len(lines):
            raise ValueError("the tokenizer joined a line feed with its neighbours")
        skip = np.where(fed.to_numpy(zero_copy_only=False), 0, 1)
        return ids, at + skip, np.diff(np.append(at, len(ids))) - skip

    def _plain(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Each text is led by a line feed, whose id falls out as the end id comes in."""
        spaced = pc.replace_substring_regex(texts, pattern=_LETTER_SIGN, replacement="\\1 \r\\2")
        spaced = pc.binary_join_element_wise("\n", pc.replace_substring(spaced, "\n", " \n"), "")
        words = pc.split_pattern(spaced, " ")
        coded = words.flatten().dictionary_encode()
        ids, starts, lengths = self._coded(coded.dictionary)
        return _gather(ids, starts, lengths, coded.indices.to_numpy(), words.offsets.to_numpy(), end_id, led=True)

    def _odd(self, texts: list[str], end_id: int) -> pa.ListArray:
        """Texts with runs of white space or special strings."""
        parts = [_SAFE_SPACE.split(t) for t in texts]
        words: dict[str, int] = {}
        others: dict[str, int] = {}
        coded: list[int] = []
        for first, *rest in parts:
            coded.append(~others.setdefault(first, len(others)))
            for p in rest:
                known = words.get(p)
                if known is None and not self.not_a_word.search(p):
                    known = words.setdefault(p, len(words))
                coded.append(~others.setdefault(" " + p, len(others)) if known is None else known)
        ids, starts, lengths = self._coded(pa.array(list(words), pa.string()))
        whole = [np.array(i, dtype=np.int32) for i in self.encode(list(others))]
        sizes = np.array([len(w) for w in whole], dtype=np.int64)
        starts = np.concatenate([starts, len(ids) + np.cumsum(sizes) - sizes])
        index = np.array(coded)
        index = np.where(index < 0, len(words) + ~index, index)
        offsets = np.cumsum([0, *map(len, parts)])
        return _gather(np.concatenate([ids, *whole]), starts, np.concatenate([lengths, sizes]), index, offsets, end_id, led=False)

    def ids(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of every whole text, and ``end_id`` after them."""
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0))
        plain = texts.filter(pc.invert(odd))
        if len(plain) == len(texts):
            return self._plain(texts, end_id)
        at = odd.to_numpy(zero_copy_only=False)
        place = np.empty(len(texts), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)])] = np.arange(len(texts))
        strange = self._odd(texts.filter(odd).to_pylist(), end_id)
        return pa.concat_arrays([self._plain(plain, end_id), strange]).take(pa.array(place)) if len(plain) else strange


def _gather(ids, starts, lengths, index, offsets, end_id: int, led: bool) -> pa.ListArray:
    """Lists of the ids of ``index[offsets[i]:offsets[i + 1]]`` and the end id; ``led`` lists lose their first id."""
    sizes = lengths[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = ids[np.repeat(starts[index] - ends[:-1], sizes) + np.arange(ends[-1])]
    bounds = ends[offsets]
    if led:
        flat = np.append(flat[1:], flat[:1])
        flat[bounds[1:] - 1] = end_id
    else:
        flat = np.insert(flat, bounds[1:], end_id)
        bounds = bounds + np.arange(len(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


def encoder(kind: type, path: str):
    """One encoder per worker process and tokenizer."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]
