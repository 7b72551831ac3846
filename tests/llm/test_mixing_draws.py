"""The draws of the mix against a draw by hand with the same numbers, and its permutations."""

from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing


def sources(spark, slots):
    rows = [(n, 1000, 1.0, b, s) for n, b, s in slots]
    return spark.createDataFrame(rows, "source string, source_size long, target double, blocks long, slots long")


@pytest.mark.parametrize("shard_slots", [7, 16, 1000])
def test_counts_are_the_draws_by_hand(spark, shard_slots):
    slots = [("a", 40, 13), ("b", 40, 90), (None, 9, 1), ("é", 40, 41), ("none", 0, 0)]
    got = {(r.source if not r.no_source else None, r.shard): r["count"]
           for r in mixing.drawn_counts(sources(spark, slots), 5, shard_slots).collect()}
    names = [("a", 13), ("b", 90), ("é", 41), (None, 1)]
    total = sum(n for _, n in names)
    shards = -(-total // shard_slots)
    want = {}
    for shard in range(shards):
        size = shard_slots if shard < shards - 1 else total - shard_slots * (shards - 1)
        edges, at = [], 0.0
        for name, n in names:
            expected = n / float(total) * size
            want[name, shard] = floor(expected)
            at += expected - floor(expected)
            edges.append(at)
        left = size - sum(want[name, shard] for name, _ in names)
        if left:
            draws = spark.range(left).select((mixing._uniform(F.lit(5), F.lit(shard).cast("bigint"), F.col("id").cast("int")) * left).alias("u"))
            for r in draws.collect():
                fell = next((i for i, e in enumerate(edges) if r.u < e), len(edges) - 1)
                want[names[fell][0], shard] += 1
        assert sum(want[name, shard] for name, _ in names) == size
    assert got == {k: v for k, v in want.items() if v}


def test_every_slot_has_a_place_and_a_block(spark):
    slots = [("a", 40, 13), ("b", 40, 90), (None, 9, 27), ("é", 40, 120)]
    rows = mixing.slots_of(sources(spark, slots), 5, 16).collect()
    blocks = {n: b for n, b, _ in slots}
    assert len({(r.shard, r.place) for r in rows}) == len(rows)
    assert all(0 <= r.place < 16 for r in rows)
    for name in blocks:
        mine = [(r["pass"], r.block) for r in rows if (None if r.no_source else r.source) == name]
        assert len(set(mine)) == len(mine) and all(0 <= b < blocks[name] for _, b in mine)
        # All blocks of a pass are taken before the next begins.
        assert {p for p, _ in mine} == set(range(-(-len(mine) // blocks[name])))
        for p in range(len(mine) // blocks[name]):
            assert {b for q, b in mine if q == p} == set(range(blocks[name]))
    capped = [r for r in rows if r.source == "é"]
    assert len(capped) <= 3 * 40


def test_permutations_are_permutations():
    for n in (1, 2, 3, 5, 17, 100, 4096, 10_007):
        for key in (0, 1, -7):
            got = mixing.permuted(np.full(n, n), np.full(n, key), np.arange(n))
            assert sorted(got.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.full(1000, 1000), np.full(1000, k), np.arange(1000)) for k in (1, 2))
    assert (a != b).sum() > 900 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.2
