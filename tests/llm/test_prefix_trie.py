"""The prefix trie against one that is walked node by node."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, a long, b long, depth int, words string"


def sequences(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    rows = []
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ended = sorted(c for c in who if len(convs[c]) == len(path))
        rows.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who),
            sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


def random_rows(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.randrange(-30, 90)
        turns = r.randrange(1, longest)
        shared = r.randrange(3)
        rows += [
            (c, r.choice([i, i, i, None]), r.choice(["user", "user", None]), f"t{shared if i < turns - 2 else r.randrange(9)} w{i % 3}")
            for i in range(turns)
        ]
    return rows + [(None, 1, "user", "no conversation"), (5, 2, None, None), (5, 2, None, None), (200, 0, "user", ""), (203, 0, "a", "only")]


@pytest.mark.parametrize("buckets", [True, False])
def test_trie_is_brute_force(spark, monkeypatch, buckets):
    if buckets:
        for name, size in (("BUCKET_TURNS", 3), ("BUCKET_BLOCKS", 2), ("BUCKET_IDS", 7)):
            monkeypatch.setattr(prefix_trie, name, size)
    rows = random_rows(2 if buckets else 1, 60, 40 if buckets else 9)
    convs = sequences(rows)
    got = prefix_trie.rebuilt_trie(conversations(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rebuilt(convs))
    if not buckets:
        got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
        assert sorted(map(tuple, got), key=repr) == brute_trie(convs)


def test_turnless_members_and_empty_tables(spark):
    # 203 keeps none of its one turn if it opens with some of a conversation that is not there.
    lone = next(c for c in range(201, 220) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "gone")]
    got = prefix_trie.rebuilt_trie(conversations(spark, rows)).collect()
    assert [tuple(r) for r in got] == brute_trie({lone: []})
    assert prefix_trie.rebuilt_trie(conversations(spark, [])).count() == 0
