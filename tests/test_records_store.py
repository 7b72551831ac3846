import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import diff, links, record
from ledgerlens.plans import extract, reports
from ledgerlens.schemas import SESSIONS, payload_view
from ledgerlens.settings import DEFAULT_PRODUCER, checkpoint_root
from ledgerlens.sources.blobs import blob_manifest
from ledgerlens.sources.objects import ObjectStore, read_object_files, union_stores
from tests.ledgers import canonical, event, exit_, raw, seal, write


@pytest.fixture(scope="module")
def session_events():
    start = {
        "runtimeId": "tester", "cwd": "C:\\w\\p", "machineId": "m1", "gitCommit": None,
        "gitRemotes": [{"name": "origin", "url": "git@github.com:acme/p.git"}], "gitRootCommits": ["a" * 40],
    }
    probe = {"coverageProbe": {"commands": [{"command": "git", "status": "shadowed"}]}}
    return seal([
        event(1, "session.start", start), event(2, "agent.output", probe), exit_(3, "make", 1),
        write(4, "c:\\w\\p\\src\\a.py", 1772359200000.5, after="r1"),
        event(5, "agent.output", {"text": "ünï \u001f \"q\""}, tier="narration"), event(6, "session.end", {"exitCode": 0}),
    ])


@pytest.fixture(scope="module")
def built(spark, session_events):
    sessions = spark.createDataFrame(
        [("s1", 1, "tester", None, "2026-03-01T10:00:00.000Z", "2026-03-01T11:00:00.000Z", 0, "C:\\w\\p")], SESSIONS
    )
    return record.build_records(raw(spark, session_events), sessions).first()


def test_record_is_canonical_and_addressed(built, session_events):
    doc = json.loads(built["doc"])
    assert canonical(doc) == built["doc"]
    body = {k: v for k, v in doc.items() if k != "recordId"}
    assert doc["recordId"] == hashlib.sha256(canonical(body).encode()).hexdigest()
    assert doc["observations"]["head"] == session_events[-1]["hash"]
    assert doc["identity"] == {"gitCommit": None, "machineId": "m1"}
    assert doc["evidence"]["integrity"]["status"] == "DEGRADED" and len(doc["evidence"]["integrity"]["degraded"]) == 1
    assert [f["id"] for f in doc["evidence"]["facts"]] == ["RF-01", "RF-03"]


def test_oversized_sessions_are_not_gathered(spark, session_events):
    sessions = spark.createDataFrame([("s1", 1, "t", None, "x", None, None, "/p")], SESSIONS)
    row = record.build_records(raw(spark, session_events), sessions, max_bytes=100).first()
    assert row["status"] == "oversize" and row["doc"] is None


def resealed(doc):
    body = {k: v for k, v in doc.items() if k != "recordId"}
    return {**body, "recordId": hashlib.sha256(canonical(body).encode()).hexdigest()}


def test_checks_and_store(spark, built):
    doc = json.loads(built["doc"])
    inflated = resealed({**doc, "evidence": {**doc["evidence"], "integrity": {**doc["evidence"]["integrity"], "status": "VERIFIED"}}})
    pointer = json.loads(built["doc"])
    pointer["evidence"]["facts"][0]["evidence"][0]["eventId"] = "ev005"
    spliced = json.loads(built["doc"])
    spliced["observations"]["events"][4]["sessionId"] = "s2"
    objects = spark.createDataFrame([
        ("a", built["doc"]), ("b", json.dumps(doc, indent=1)), ("c", canonical(inflated)),
        ("d", canonical(resealed(pointer))), ("e", canonical(resealed(spliced))), ("f", '{"format":1}'), ("g", "nope"),
        ("h", canonical(resealed({**doc, "generator": {"name": "x", "version": "1e3"}, "extra": 1e21}))),
    ], "source string, doc string")
    got = {r["source"]: (r["verdict"], r["errors"]) for r in record.check_records(objects).collect()}
    assert got["a"] == got["b"] == ("verified", [])
    assert got["c"][1] == ["integrity claim: record states VERIFIED; these bytes verify to DEGRADED"]
    assert got["d"][1] == [
        "RF-01: cites seq 3, event has seq 5", f"RF-01: cites ts {doc['observations']['events'][2]['ts']}, event has ts {doc['observations']['events'][4]['ts']}",
        "RF-01: cites a narration-tier event (ev005)",
    ]
    assert [e.split(":")[0] for e in got["e"][1]] == ["session identity", "hash chain", "integrity claim"]
    assert got["f"][1][0].endswith("(missing format marker)") and got["g"][1] == ["not valid JSON"]

    here = ObjectStore(spark, f"{checkpoint_root(spark)}/t-{uuid.uuid4().hex}")
    there = ObjectStore(spark, f"{checkpoint_root(spark)}/t-{uuid.uuid4().hex}")
    status = {r["source"]: r["status"] for r in here.add_records(objects).collect()}
    assert status == {"a": "added", "b": "duplicate", "c": "refused", "d": "refused", "e": "refused", "f": "refused", "g": "refused", "h": "added"}
    assert {r["status"] for r in here.add_records(objects.where("source = 'a'")).collect()} == {"duplicate"}
    first = union_stores(there, here).collect()
    assert all(r["status"] == "added" and r["direction"] == "pull" for r in first) and first
    assert union_stores(there, here).count() == 0
    assert there.objects("record").where(F.col("object_id") == built["record_id"]).first()["doc"] == built["doc"]
    assert there.verify()[1].first()["store_intact"]


def test_files(spark, built, tmp_path):
    (tmp_path / "a.record.json").write_bytes(b"\xef\xbb\xbf" + built["doc"].encode())
    page = f'<html><script type="application/json" id="{DEFAULT_PRODUCER.record_format}">{{"x":1}}</script></html>'
    (tmp_path / "b.html").write_text(page)
    (tmp_path / "c.html").write_text("<p>none</p>")
    (tmp_path / "d.json").write_text("x" * 3000)
    limit = len(built["doc"].encode()) + 10
    rows = {r["source"].rsplit("/", 1)[1]: r for r in read_object_files(spark, str(tmp_path), max_bytes=limit).collect()}
    assert rows["a.record.json"]["doc"] == built["doc"] and rows["b.html"]["doc"] == '{"x":1}'
    assert rows["c.html"]["errors"] == ["this HTML file carries no embedded evidence record"]
    big = {r["source"].rsplit("/", 1)[1]: r for r in read_object_files(spark, str(tmp_path), max_bytes=2000).collect()}
    assert big["d.json"]["doc"] is None and "bytes" in big["d.json"]["errors"][0]

    (tmp_path / "e.env").write_text("K=V")
    (tmp_path / "f.bin").write_bytes(b"a\x00b")
    seen = {r["path"].rsplit("/", 1)[1]: r for r in blob_manifest(spark, str(tmp_path), max_bytes=2000).collect()}
    assert seen["e.env"]["sensitive"] and seen["e.env"]["ref"] is None
    assert seen["d.json"]["oversized"] and seen["f.bin"]["binary"]
    assert seen["f.bin"]["ref"] == hashlib.sha256(b"a\x00b").hexdigest()


def test_extraction(spark, built):
    tables = extract.extract(spark.createDataFrame([("a", built["doc"]), ("b", "x")], "source string, doc string"))
    row = tables.records.first()
    assert (row["machine_id"], row["cwd"], row["event_count"]) == ("m1", "C:\\w\\p", 6)
    assert {(r["kind"], r["value"]) for r in tables.signals.collect()} == {
        ("origin", "github.com/acme/p"), ("remote", "github.com/acme/p"), ("root", "a" * 40)}
    touched = tables.file_events.first()
    assert (touched["rel_path"], touched["occurred_ts"], touched["occurred_source"]) == (
        "src/a.py", "2026-03-01T10:00:00.000Z", "mtime")
    assert tables.unreadable.first()["unreadable"] == 1


def test_links(spark):
    claims = spark.createDataFrame([
        ("ann", "t1", "identity:same-repo", "evidence:repo/a", "evidence:repo/b", "é\"x"),
        ("ann", "t2", "identity:same-repo", "evidence:repo/a", "evidence:repo/a", ""),
        ("ann", "t3", "x-own:kind", "https://x", "evidence:odd", ""),
        ("ann", "t4", "retracts", "evidence:repo/a", "evidence:repo/b", ""),
    ], "author string, ts string, type string, `from` string, `to` string, reason string")
    made = links.make_links(claims)
    one = made.where("ts = 't1'").first()
    doc = json.loads(one["doc"])
    assert doc.pop("linkId") == one["link_id"] == hashlib.sha256(canonical(doc).encode()).hexdigest()
    got = {r["source"]: (r["verdict"], len(r["errors"])) for r in links.check_links(made.select(F.col("ts").alias("source"), "doc")).collect()}
    assert got == {"t1": ("verified", 0), "t2": ("invalid", 1), "t3": ("invalid", 2), "t4": ("invalid", 1)}


def test_changes_and_diffs(spark):
    events = seal([
        write(1, "/p/a", before="b1", after="b2"), write(2, "/p/a", before="b2", after="b3"),
        write(3, "/p/b", before="b1", after="gone"),
        event(4, "file.write", {"path": "/p/.env", "contentWithheld": "sensitive"}),
        event(5, "file.delete", {"path": "/p/a"}, target={"resolved": "/p/a", "inScope": True}),
    ])
    view = payload_view(raw(spark, events)).drop("_p")
    sessions = spark.createDataFrame([("s1", 1, "t", None, "x", None, None, "/p")], SESSIONS)
    texts = {"b1": "1\n2\n3", "b2": "x", "b3": "0\n1\n3\n4"}
    blobs = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()], "ref string, content binary")
    changes = reports.file_changes(view, sessions, blobs)
    got = {r["display"]: r for r in changes.collect()}
    assert (got["a"]["writes"], got["a"]["deleted"], got["a"]["before_ref"], got["a"]["after_ref"]) == (2, True, "b1", "b3")
    assert (got["b"]["content"], got[".env"]["content"]) == ("blob-missing", "withheld")
    lines = diff.line_diff(diff.diff_inputs(changes, blobs)).where("path = '/p/a'").orderBy("line_no").collect()
    assert [r["op"] + r["text"] for r in lines] == ["+0", " 1", "-2", " 3", "+4"]
