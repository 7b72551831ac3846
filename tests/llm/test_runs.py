"""Periodic runs against a scan of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import periodic_runs
from tests.llm.test_operators import ODD, documents


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def texts_of(r):
    for _ in range(r.choice([1, 3, 10])):
        n, k = r.choice([0, 1, 5, 6, 7, 20, 60, 200, 400]), r.choice([1, 2, 3, 50])
        words = [str(r.randrange(k)) for _ in range(n)]
        for _ in range(r.randrange(3) if n > 8 else 0):
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // r.choice([2, 3, 4, 5, 8])))
            for i in range(a, r.randrange(a, n + 1)):
                words[i] = words[a + (i - a) % p]
        yield words


@pytest.mark.parametrize("direct", [1, 2, 8])
def test_runs_are_brute_force(monkeypatch, direct):
    monkeypatch.setattr(periodic_runs, "DIRECT", direct)
    r = random.Random(direct)
    for _ in range(150):
        docs = list(texts_of(r))
        words, counts = periodic_runs.split_words(pa.array([" \n".join(d) for d in docs]))
        ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        want, base = [], 0
        for d in docs:
            want += [(s + base, e + base, q) for s, e, q in brute_runs(d)]
            base += len(d)
        assert [tuple(x) for x in periodic_runs.find_runs(ids, counts).tolist()] == want


def test_a_long_period_is_found():
    n, period = 300_000, 70_001
    assert periodic_runs.find_runs(np.arange(n) % period, np.array([n])).tolist() == [[0, n, period]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha(told), sha(kept))


def test_rows_on_odd_texts(spark):
    r = random.Random(9)
    texts = [t for t in ODD if not t or len(t) < 20_000] + [" ".join(d) for _ in range(12) for d in texts_of(r)]
    texts += ["a " * 5, "a " * 6, "  x " * 9, "b\x1cb " * 7, "a " * 5000]
    ids = [None, None, *range(2, len(texts))]
    docs = documents(spark, texts, ids=ids)
    for size in (periodic_runs.GROUP_BYTES, 300):
        periodic_runs.GROUP_BYTES, before = size, periodic_runs.GROUP_BYTES
        try:
            got = periodic_runs.summaries(periodic_runs.scan(docs, plant=True)).collect()
        finally:
            periodic_runs.GROUP_BYTES = before
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(expected, ids, texts)))
    assert periodic_runs.summaries(periodic_runs.scan(docs.limit(0), plant=True)).count() == 0


def test_documents_are_collapsed_in_place(spark):
    docs = documents(spark, ["x  " + "a b c " * 8 + "y", "left  as it is", None, ""])
    out = periodic_runs.without_runs(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["x a b c y", "left  as it is", None, ""]
    assert {r.slot for r in out.collect()} == {1}
