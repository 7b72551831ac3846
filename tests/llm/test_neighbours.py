"""Nearest neighbours: odd rows answered exactly, and recall with the settings that the query has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import vectors
from ledgerlens.llm.common import table
from ledgerlens.llm.queries import QUERIES


def searched(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = {}
    for r in vectors.nearest(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r["score"]))
    return {q: sorted(rows) for q, rows in found.items()}


def test_every_length_is_searched_among_its_own(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(2 + i % 3)) for i in range(301)]
    got = searched(spark, [*rows, (1000, np.ones(9))])
    of = dict(rows)
    assert set(got) == {i for i in of if i % 50 == 0}
    for q, best in got.items():
        same = {i: v @ of[q] / np.linalg.norm(v) / np.linalg.norm(of[q]) for i, v in of.items() if i != q and len(v) == len(of[q])}
        assert [i for _, i, _ in best] == sorted(same, key=lambda i: (-same[i], i))[:5]


def test_rows_with_one_id_are_rows_of_their_own(spark):
    got = searched(spark, [(0, [1, 0]), (0, [1, 1]), (3, [0, 1])])
    half = 1 / np.sqrt(2)
    assert [(rank, i) for rank, i, _ in got[0]] == [(1, 0), (1, 0), (2, 3), (2, 3)]
    assert sorted(s for _, _, s in got[0]) == pytest.approx([0, half, half, half])


def test_very_large_and_very_small_components(spark):
    got = searched(spark, [(0, [3e200, 4e200]), (1, [3e-200, 4e-200]), (2, [1e308, 0]), (4, [5e-324, 0])])
    assert [(i, s) for _, i, s in got[0]] == [(1, pytest.approx(1)), (2, pytest.approx(0.6)), (4, pytest.approx(0.6))]


def test_ties_go_to_the_smaller_id(spark):
    v = np.random.default_rng(4).standard_normal(64)
    got = searched(spark, [(0, v), *((k, v) for k in range(900, 100, -1))])
    assert {s for _, _, s in got[0]} == {got[0][0][2]} and [i for _, i, _ in got[0]] == [101, 102, 103, 104, 105]


def test_recall_with_the_settings_of_the_query(spark):
    """2000 vectors are one block, of which a quarter is compared, as in any block."""
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in table(spark, sf_dir, "embeddings").collect()}
    assert vectors.CANDIDATE_SHARE * len(rows) >= vectors.LEAST_CANDIDATES
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = {}
    for r in QUERIES["op5_neighbours"](spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, mine in found.items():
        score = np.where(ids == q, -2, unit @ (rows[q] / np.linalg.norm(rows[q])))
        hits += len(mine & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert set(found) == {int(i) for i in ids if i % 50 == 0} and hits >= 0.95 * 5 * len(found)
