"""Tables of whole documents lie in small row groups, and objects are judged without their texts."""

import json
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgerlens.operators import record
from ledgerlens.plans import extract
from ledgerlens.settings import DEFAULT_PRODUCER, FORMAT_VERSION, LONG_TEXTS, checkpoint_root, settle_texts
from ledgerlens.sources.objects import ObjectStore

ROWS = LONG_TEXTS["parquet.block.row.count.limit"]


def groups(frame):
    """Rows and bytes of every row group of a table that was written."""
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in frame.inputFiles()]
    return [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in files for i in range(m.num_row_groups)]


def documents(spark, n, filler):
    """Records of no known format, each with a text that does not compress."""
    noise = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(filler)), lambda i: F.sha2(F.concat_ws("-", "id", i).cast("binary"), 256)))
    doc = F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"t":"'), noise, F.lit('"}'))
    return spark.range(n).coalesce(1).select(F.col("id").cast("string").alias("source"), doc.alias("doc"))


def test_read_documents_lie_in_small_row_groups(spark):
    read = record.read_objects(documents(spark, 1000, 10))
    found = groups(read.even)
    assert sum(n for n, _ in found) == 1000 and max(n for n, _ in found) <= ROWS


def test_few_long_documents_fill_a_row_group(spark):
    kept = settle_texts(documents(spark, 40, 16_384), "long")  # 1 MB each
    found = groups(kept)
    assert sum(n for n, _ in found) == 40 and max(size for _, size in found) < 2 * LONG_TEXTS["parquet.block.size"] + 2**21
    assert kept.count() == 40


def sealed(spark, n):
    """Records without events, as long as their catalog makes them."""
    body = {
        "evidence": {"catalog": ["RF-01"] * 20, "closed": True, "coverage": [], "facts": [], "integrity": {"chain": {}, "degraded": [], "status": "VERIFIED"}},
        "format": DEFAULT_PRODUCER.record_format, "formatVersion": FORMAT_VERSION, "generator": {"name": "a", "version": "1"},
        "identity": {}, "observations": {"count": 0, "events": [], "genesis": "0" * 64, "head": "0" * 64},
    }
    subject = {"cwd": "/p", "runtimeId": "r", "sessionNumber": 1, "startedAt": "x"}
    rows = []
    for k in range(n):
        doc = {**body, "subject": {**subject, "sessionId": f"s{k:04d}"}}
        text = json.dumps(doc, sort_keys=True, separators=(",", ":"))
        rows.append((f"s{k:04d}", text))
    frame = spark.createDataFrame(rows, "source string, body string")
    id_ = F.sha2(F.col("body").cast("binary"), 256)
    doc = F.replace("body", F.lit(',"subject":'), F.concat(F.lit(',"recordId":"'), id_, F.lit('","subject":')))
    return frame.select("source", doc.alias("doc"), id_.alias("record_id"))


def test_outcomes_hold_no_texts_and_the_store_has_them_all(spark, tmp_path):
    docs = sealed(spark, 300)
    # One record under two sources, and two texts under one source.
    twice = docs.where("source = 's0000'").select(F.lit("t0000").alias("source"), "doc").union(
        spark.createDataFrame([("bad", "{}"), ("bad", "[]")], "source string, doc string"))
    store = ObjectStore(spark, str(tmp_path / "store"))
    before = set(Path(checkpoint_root(spark)).glob("add-records-*"))
    told = store.add_records(docs.select("source", "doc").union(twice)).collect()
    new = set(Path(checkpoint_root(spark)).glob("add-records-*")) - before
    assert len(new) == 1 and "doc" not in spark.read.parquet(str(new.pop())).columns
    status = {r.source: r.status for r in told}
    assert [s for s, x in status.items() if x != "added"] and status["t0000"] == "duplicate" and status["bad"] == "refused"
    assert sum(x == "added" for x in status.values()) == 300
    kept = {r.object_id: r.doc for r in store.objects("record").collect()}
    assert kept == {r.record_id: r.doc for r in docs.collect()}
    assert {r.status for r in store.add_records(docs.select("source", "doc")).collect()} == {"duplicate"}
    assert store.verify()[1].first().store_intact
    assert max(n for n, _ in groups(store.objects("record"))) <= ROWS


def test_documents_do_not_move_to_their_checks(spark):
    tables = extract.extract(sealed(spark, 5).select("source", "doc").union(spark.createDataFrame([("x", "{}")], "source string, doc string")))
    assert tables.records.count() == 5 and tables.unreadable.first().unreadable == 1
    plan = tables.facts._jdf.queryExecution().executedPlan().toString()
    assert tables.facts.count() == 0 and "LeftSemi" not in plan
