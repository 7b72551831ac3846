"""Near-duplicates: what the trees and the token filter may lose."""

from math import comb

import numpy as np
import pytest

from ledgerlens.llm import near_duplicates as near


def agreeing_in_fewer(similarity, need):
    n = near.POSITIONS
    return sum(comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(need))


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_candidates_agree_in_as_few_tokens_as_the_miss_probability_says(spark, similarity):
    agree = next(k for k in range(near.POSITIONS) if agreeing_in_fewer(similarity, k + 1) > 1e-10)
    one = np.arange(near.POSITIONS)
    two = np.where(one < agree, one, -1 - one)
    rows = [(7, 2, i, t.tolist()) for i, t in ((1, one), (2, two))]
    nodes = spark.createDataFrame(rows, "node long, members long, id long, tokens array<int>")
    assert [tuple(r) for r in near.candidate_links(nodes, similarity).collect()] == [(2, 1)]
    assert agreeing_in_fewer(similarity, agree) < near.miss_probability(similarity) < 1e-9


def test_simulated_pairs_pass_the_filter():
    r = np.random.default_rng(1)
    for similarity in (0.8, 0.85):
        same = r.random((200_000, near.POSITIONS), dtype=np.float32) < similarity
        assert (same.sum(axis=1) >= near.needed(similarity)).all()


def test_every_branch_of_every_tree_reads_a_token_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL_NODE", 1)
    assert near.POSITIONS == near.TREES * (2 + 4 + 8)
    # A pair that agrees in the tokens along one way down, and in nothing else, meets in the leaf.
    for way in ((0, 2, 6), (1, 5, 13), (14, 17, 22)):
        two = [5 if k in way else -1 - k for k in range(near.POSITIONS)]
        one = [5 if k in way else k for k in range(near.POSITIONS)]
        found = near.leaves(spark.createDataFrame([(1, one), (2, two)], "id long, tokens array<int>")).collect()
        assert sorted(x.id for x in found) == [1, 2]
