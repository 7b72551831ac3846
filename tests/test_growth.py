"""Work that must not grow with the number of small groups, files or repeated words."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.operators import diff
from ledgerlens.plans import queries_text
from ledgerlens.schemas import DRAFT_COLUMNS
from ledgerlens.sources.blobs import blob_manifest, files_below
from ledgerlens.streaming import ingest


def pages(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("page "), "id").alias("html"))
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    return queries_text.page_files(spark, str(tmp_path))


def test_pages_lie_in_a_bounded_number_of_folders(spark, tmp_path):
    path = pages(spark, tmp_path, 600)
    top = [d for d in os.listdir(path) if "=" in d]
    assert len(top) <= queries_text.PAGE_PARTS
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) == 600
    read = queries_text.read_object_files(spark, path).select(queries_text._page_of(F.col("source"))).collect()
    assert sorted(r.page_id for r in read) == list(range(600))


def test_a_manifest_reads_its_files_once(spark, tmp_path):
    path = pages(spark, tmp_path, 3)
    files = files_below(spark, path)
    manifest = blob_manifest(spark, path, files=files)
    assert manifest._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1
    assert manifest.where("ref is not null and not sensitive and not oversized").count() == 3


def test_pairs_without_a_common_line_need_no_search(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(diff, "_common", refuse)
    script = diff._align("\n".join(f"a{i}" for i in range(50)), "\n".join(f"b{i}" for i in range(60)))
    assert script == [("-", f"a{i}") for i in range(50)] + [("+", f"b{i}") for i in range(60)]


def test_lines_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(diff, "OUT_LINES", 4)
    given = pa.table({
        "session_id": ["s"] * 3, "path": ["a", "b", None], "before": ["1\n2", None, "x"], "after": ["2\n3", "1\n2\n3", "x"],
    }).to_batches()
    out = list(diff._align_batches(given))
    assert [b.num_rows for b in out] == [6, 1]
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows[:3] == [("s", "a", 0, "-", "1"), ("s", "a", 1, " ", "2"), ("s", "a", 2, "+", "3")]
    assert rows[-1] == ("s", None, 0, " ", "x")


def test_many_sessions_share_one_group_of_the_stream(spark, tmp_path, monkeypatch):
    """With one bucket all sessions, and rows without one, keep chains of their own over two arrivals."""
    monkeypatch.setattr(ingest, "CHAIN_BUCKETS", 1)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for arrival in range(2):
        rows = []
        for s in (*(f"s{i}" for i in range(30)), None):
            row = dict.fromkeys(DRAFT_COLUMNS)
            row.update(id=f"{s}-{arrival}", session_id=s, ts=f"2026-03-01T10:00:0{arrival}.000Z", kind="file.read", payload="{}")
            rows.append(tuple(row[c] for c in DRAFT_COLUMNS))
        kinds = {"monotonic_ts": "bigint", "reversible": "boolean", "taint": "boolean"}
        schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in DRAFT_COLUMNS)
        drafts = spark.createDataFrame(rows, schema)
        drafts.write.mode("append").parquet(source)
        stream = ingest.read_drafts(spark, source, drafts.schema)
        ingest.start_sealing(stream, sink, state, exact=False).awaitTermination()
    out = spark.read.parquet(sink).collect()
    chains = {}
    for r in out:
        chains.setdefault(r.session_id, {})[r.seq] = r
    assert len(chains) == 31 and all(set(c) == {1, 2} for c in chains.values())
    assert all(c[1].prev_hash == "0" * 64 and c[2].prev_hash == c[1].hash for c in chains.values())
    assert len({r.hash for r in out}) == 62


def test_words_of_earlier_groups_are_not_encoded_again(monkeypatch):
    from ledgerlens.llm import tokens
    from ledgerlens.llm.queries import vocabulary

    monkeypatch.setattr(tokens, "MOST_PIECES", 40)
    path = vocabulary("byte_bpe_50k.json")
    enc, asked = tokens.SpaceEncoder(path), []
    lines = enc._lines
    enc._lines = lambda pieces: (asked.append(len(pieces)), lines(pieces))[1]
    texts = ["alpha beta, gamma\ndelta", "gamma beta alpha", "a  b <|endoftext|> alpha beta"]
    first = enc.ids(pa.array(texts), 0).to_pylist()
    begun = sum(asked)
    assert enc.ids(pa.array(texts), 0).to_pylist() == first and sum(asked) == begun
    # Past the bound only the group at hand is held, or nothing, and ids stay those of the library.
    rng = np.random.default_rng(5)
    for size in (30, 30, 60, 10):
        group = [" ".join(f"w{n}" for n in rng.integers(0, 1000, size)), *texts]
        wanted = [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in group]
        assert enc.ids(pa.array(group), 0).to_pylist() == wanted
        assert len(enc.pieces) <= 40
