"""Facts that follow the ledger: only the parts of touched sessions are read."""

import json
import os

from pyspark.sql import functions as F

from ledgerlens.operators.facts import evaluate
from ledgerlens.schemas import RAW_EVENTS, payload_view
from ledgerlens.streaming import ingest


def raw(spark, rows):
    names = [c.split(" ")[0] for c in RAW_EVENTS.split(", ")]
    made = []
    for session, seq, kind, payload in rows:
        row = dict.fromkeys(names)
        row.update(id=f"{session}-{seq}", session_id=session, seq=seq, kind=kind, ts=f"2026-03-01T10:00:{seq:02d}.000Z",
                   signal_tier="groundTruth", payload=json.dumps(payload))
        made.append(tuple(row[n] for n in names))
    return spark.createDataFrame(made, RAW_EVENTS)


def failed(session, seq):
    return session, seq, "process.exit", {"command": f"make {seq}", "exitCode": 1, "cwd": "/p"}


def test_a_batch_reads_the_parts_of_its_sessions(spark, tmp_path):
    sessions = [f"s{i}" for i in range(40)]
    ledger, found, state, source = (str(tmp_path / n) for n in ("ledger", "facts", "state", "in"))
    final, final_state, other = (str(tmp_path / n) for n in ("final", "final-state", "ledger2"))
    batches = [
        [failed(s, 1) for s in sessions],
        [failed("s1", 2), ("s2", 2, "session.end", {})],
        [("s1", 3, "session.end", {}), failed("s2", 3)],
    ]
    everything = []
    for rows in batches:
        everything += rows
        raw(spark, rows).write.mode("append").parquet(source)
        runs = [(found, ledger, state, False), (final, other, final_state, True)]
        for out, place, checkpoint, ended in runs if rows is not batches[1] else runs[:1]:
            stream = spark.readStream.schema(raw(spark, rows).schema).parquet(source)
            ingest.start_facts(stream, place, out, checkpoint, ended_only=ended).awaitTermination()
    key = lambda df: sorted((r.session_id, r.statement) for r in df.collect())
    whole = evaluate(payload_view(raw(spark, everything)).drop("_p"))
    assert key(ingest.current_facts(spark, found)) == key(whole) and whole.count() == 42
    assert key(ingest.current_facts(spark, final)) == key(whole.where(F.col("session_id").isin("s1", "s2")))
    # Only the parts asked for are scanned.
    bucket = spark.createDataFrame([("s1",)], "session_id string").select(ingest.ledger_bucket()).first()[0]
    part = ingest.stored_ledger(spark, ledger, raw(spark, everything).schema, [bucket])
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and f"(bucket#" in scan.split("PartitionFilters: [")[1]
    read = {r.f for r in part.select(F.input_file_name().alias("f")).collect()}
    assert read and all(f"/bucket={bucket}/" in f for f in read)
    assert part.where("session_id = 's1'").count() == 3


def test_events_are_parsed_once_and_parts_are_single_files(spark, tmp_path, monkeypatch):
    ledger, found, state, source = (str(tmp_path / n) for n in ("ledger", "facts", "state", "in"))
    parsed, whole_view = [], ingest.payload_view
    monkeypatch.setattr(ingest, "payload_view", lambda rows, producer: (parsed.append(rows.count()), whole_view(rows, producer))[1])
    everything = []
    for n in (1, 2, 3):
        rows = [failed(f"s{i}", n) for i in range(20)]
        everything += rows
        raw(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw(spark, rows).schema).parquet(source)
        ingest.start_facts(stream, ledger, found, state).awaitTermination()
    assert parsed == [20, 20, 20]
    key = lambda df: sorted((r.session_id, r.statement) for r in df.collect())
    assert key(ingest.current_facts(spark, found)) == key(evaluate(whole_view(raw(spark, everything)).drop("_p")))
    for kept in (ledger, f"{found}/views", f"{found}/facts", f"{found}/touched"):
        files = [(folder, f) for folder, _, names in os.walk(kept) for f in names if f.endswith(".parquet")]
        assert files and len(files) == len({folder for folder, _ in files})
