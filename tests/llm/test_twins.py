"""The queries of the package against their SQL twins, and every query over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.llm.decontamination import words_of
from ledgerlens.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert ours == sorted(map(repr, cursor.fetchall()))


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    counts = [docs.count()]
    from ledgerlens.settings import settle

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name != "mixing":
            rows = docs.collect()
            assert len({r.doc_id for r in rows}) == len(rows)
            assert all(r.n_chars == len(r.text) for r in rows)
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    words = lambda text: set(words_of((text or "").encode()))
    assert all(words(r.text) <= words(first[r.doc_id].text) for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).orderBy("start").collect()
    assert len(out) == docs.count()
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
