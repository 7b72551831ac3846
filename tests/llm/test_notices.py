"""Notices against the edit distance of all spans of words."""

import random
import re

import pytest

from ledgerlens.llm import notices
from ledgerlens.llm.notices import Finder, Notice
from tests.llm.test_operators import ODD, documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def spans(words, notice):
    text = notice.text
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            span = " ".join(words[i:j])
            if len(span) > len(text) + notice.edits:
                break
            if len(span) >= len(text) - notice.edits and (d := distance(span, text)) <= notice.edits:
                yield i, j, d


def mutated(r, text, edits):
    for _ in range(edits):
        p = r.randrange(len(text))
        text = r.choice([text[:p] + text[p + 1:], text[:p] + r.choice("xy eé") + text[p:], text[:p] + r.choice("xyz ") + text[p + 1:]]) or "a"
    return text


@pytest.mark.parametrize("seed", range(4))
def test_places_are_brute_force(seed):
    known = notices.notices()
    finder, r = Finder(known), random.Random(seed)
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            n = r.choice(known)
            parts.append(mutated(r, n.text, r.randrange(n.edits + 3)))
            parts.append(r.choice(["", "filler words", "license", "the"]))
        words = " ".join(parts).split()
        text = " ".join(words)
        found = finder.find(text)
        for i, n in enumerate(known):
            want = list(spans(words, n))
            mine = [f for f in found if f[0] == i]
            assert {(len(text[:a].split()), e) for _, a, _, e in mine if not e} == {(a, d) for a, _, d in want if not d}
            # Every span is found or overlaps one that is no worse; every one found is a span.
            told = {(len(text[:a].split()), len(text[:a].split()) + len(text[a:b].split()), e) for _, a, b, e in mine}
            assert told <= set(want)
            assert all(any(x < b and a < y and e <= d for x, y, e in told) for a, b, d in want)


def test_rows_on_odd_texts(spark):
    texts = [*ODD, "Under the MIT License, or the MIT\tlicense!", "cc-by CC BY", "GNU General Publik Licence v3", "xmit license",
             "the apache-license", "a gnugeneral public license"]
    docs = documents(spark, texts, ids=[None, None, *range(2, len(texts))])
    got = {r.doc_id: r for r in notices.licenses(docs).collect() if r.doc_id is not None}
    at = len(ODD)
    row = lambda i: tuple(got[at + i])[2:]
    assert row(0) == (2, 2, 6, "mit", "mit", 1.0)
    assert row(1) == (2, 0, 2, "cc-by", "cc-by", 1.0)
    assert row(2) == (0, None, None, "", "gpl", pytest.approx(1 - 2 / 26))
    assert row(3) == (0, None, None, "", "", 0.0)
    assert row(4) == (1, 1, 1, "apache", "apache", 1.0)
    assert row(5) == (0, None, None, "", "gpl", pytest.approx(1 - 1 / 26))
    for i, t in enumerate(ODD[2:], 2):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert got[i].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)) and got[i].labels == ""
    assert notices.licenses(docs).count() == len(texts)
    assert notices.licenses(docs.limit(0)).count() == 0


def test_phrases_of_ones_own(spark):
    docs = documents(spark, ["a b a b a", ""])
    got = notices.licenses(docs, (Notice("a b a", "aba", True),)).orderBy("doc_id").collect()
    assert tuple(got[0]) == (0, 5, 2, 0, 2, "aba", "aba", 1.0)
    assert notices.licenses(docs, ()).where("score = 0 and labels = ''").count() == 2
