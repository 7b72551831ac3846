"""Records in rows against records as whole texts."""

import json

from pyspark.sql import functions as F

from ledgerlens.operators import record, record_rows
from ledgerlens.schemas import RAW_EVENTS

SESSIONS = (
    "id string, number bigint, started_at string, ended_at string, mission string, cwd string, runtime_id string, exit_code int"
)


def ledger(spark, sessions, events):
    names = [c.split(" ")[0] for c in RAW_EVENTS.split(", ")]
    rows = []
    for session, seq, kind, payload in events:
        row = dict.fromkeys(names)
        row.update(
            id=f"{session}-{seq}", session_id=session, seq=seq, kind=kind, ts=f"2026-03-01T10:00:{seq % 60:02d}.000Z", monotonic_ts=seq,
            actor='{"type":"human"}', source="s", signal_tier="groundTruth", payload=json.dumps(payload), prev_hash="0" * 64, hash="0" * 64,
        )
        rows.append(tuple(row[n] for n in names))
    listed = [(s, n, "2026-03-01T10:00:00.000Z", end, "été", "/p", "r", 0) for n, (s, end) in enumerate(sessions, 1)]
    return spark.createDataFrame(rows, RAW_EVENTS), spark.createDataFrame(listed, SESSIONS)


def sample(spark):
    fail = lambda s, n: (s, n, "process.exit", {"command": f"make {n} é", "exitCode": 1, "cwd": "/p"})
    events = [fail("a", n) for n in range(1, 40)] + [("a", 40, "session.end", {}), fail("b", 1), ("b", 2, "note", {"x": [1, {"y": None}]})]
    return ledger(spark, [("a", "2026-03-01T10:01:00.000Z"), ("b", None), ("none", "2026-03-01T10:01:00.000Z")], events)


def test_the_same_texts_and_addresses(spark):
    raw, sessions = sample(spark)
    whole = {r.session_id: r for r in record.build_records(raw, sessions).collect()}
    headers, parts = record_rows.sealed_rows(raw, sessions)
    rows = {r.session_id: r for r in headers.collect()}
    docs = {r.session_id: r.doc for r in record_rows.spelled_out(headers, parts).collect()}
    assert set(rows) == set(docs) == set(whole) == {"a", "b", "none"}
    for s, r in whole.items():
        assert docs[s] == r.doc and rows[s].record_id == r.record_id and rows[s].bytes == len(r.doc.encode())
        assert (rows[s].status, rows[s].event_count, rows[s].fact_count) == (r.status, r.event_count, r.fact_count)
    checks = record.check_records(record_rows.spelled_out(headers, parts).select(F.col("session_id").alias("source"), "doc"))
    assert {r.actual_id for r in checks.collect()} == {r.record_id for r in whole.values()}


def test_the_store_adds_once_checks_and_reads_one(spark, tmp_path):
    raw, sessions = sample(spark)
    store = record_rows.RowStore(spark, str(tmp_path / "store"))
    assert store.verify().count() == 0
    told = lambda: {(r.source, r.status) for r in store.add_sessions(raw, sessions).collect()}
    assert told() == {("session #1", "added"), ("session #2", "skipped-open"), ("session #3", "added")}
    assert told() == {("session #1", "duplicate"), ("session #2", "skipped-open"), ("session #3", "duplicate")}
    assert {(r.session_id, r.verdict) for r in store.verify().collect()} == {("a", "verified"), ("none", "verified")}
    wanted = store.headers().where("session_id = 'a'").first().record_id
    header, parts = store.read(wanted)
    assert record_rows.spelled_out(header, parts).count() == 1 and parts.where(F.col("section") == record_rows.EVENTS).count() == 40
    changed = store.parts().withColumn("text", F.when(F.col("number") == 7, F.replace("text", F.lit("make"), F.lit("fake"))).otherwise(F.col("text")))
    assert {(r.session_id, r.verdict) for r in record_rows.checked_rows(store.headers(), changed).collect()} == {("a", "altered"), ("none", "verified")}
    gone = store.parts().where("session_id = 'a'")
    assert {(r.session_id, r.verdict) for r in record_rows.checked_rows(store.headers(), gone).collect()} == {("a", "verified"), ("none", "missing")}


def test_no_sessions(spark):
    raw, sessions = ledger(spark, [], [])
    headers, parts = record_rows.sealed_rows(raw, sessions)
    assert headers.count() == 0 and parts.count() == 0
