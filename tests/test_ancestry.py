"""Failing ancestors against a walk up every tree, circles and doubled executions among them."""

import random

import pytest

from ledgerlens.operators.ancestry import Ancestry


def walk(exits, failures):
    parent = {}
    for s, seq, x, p in sorted(exits, key=lambda e: e[1]):
        if x is not None and p is not None:
            parent[s, x] = p
    failing = {(s, x) for s, _, x, _ in failures if x is not None}
    subsumed, descends = set(), set()
    for s, seq, x, p in failures:
        seen, way, at = {x} - {None}, [], p
        while at is not None and at not in seen:
            seen.add(at)
            way.append(at)
            at = parent.get((s, at))
        if at is None and any((s, a) in failing for a in way):
            subsumed.add((s, seq))
        met, at = set(), p
        while at is not None and at not in met:
            met.add(at)
            at = parent.get((s, at))
        descends |= {(s, seq, a) for a in met if (s, a) in failing and a != x}
    return subsumed, descends


def checked(spark, exits, failures):
    schema = "session_id string, seq long, exec_id string, parent_exec_id string"
    found = Ancestry(spark.createDataFrame(failures, schema), spark.createDataFrame(exits, schema))
    subsumed, descends = walk(exits, failures)
    assert {tuple(r) for r in found.subsumed().collect()} == subsumed
    got = [tuple(r) for r in found.descends().collect()]
    assert len(got) == len(set(got)) and set(got) == descends


@pytest.mark.parametrize("seed", range(3))
def test_trees_and_circles(spark, seed):
    r = random.Random(seed)
    exits = []
    for s in range(12):
        n = r.choice([1, 3, 8, 30])
        for seq in range(n):
            up = r.choice([None, seq - 1, seq - 1, r.randrange(n), seq - 1 if s % 2 else seq])
            name = r.randrange(n) if r.random() < 0.1 else seq
            exits.append((f"s{s}", seq, None if r.random() < 0.05 else f"x{name}", None if up is None or up < 0 else f"x{up}"))
    checked(spark, exits, [e for e in exits if r.random() < 0.4])


def test_a_thousand_deep_chain_and_a_long_circle(spark):
    chain = [("c", i, f"x{i}", f"x{i - 1}" if i else None) for i in range(1000)]
    ring = [("r", i, f"y{i}", f"y{(i + 1) % 21}") for i in range(21)]
    checked(spark, chain + ring, [e for e in chain + ring if e[1] % 10 == 3 or e[0] == "r"])


def test_no_failures_and_no_parents(spark):
    checked(spark, [("a", 1, "x", None)], [])
    checked(spark, [("a", 1, "x", None)], [("a", 1, "x", None)])
    checked(spark, [], [("a", 1, None, None), (None, 2, "z", "z")])
