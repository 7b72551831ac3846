"""Records have a bound only where the caller gives one."""

from pyspark.sql import functions as F

from ledgerlens.operators import record
from ledgerlens.schemas import SESSIONS
from ledgerlens.sources.objects import ObjectStore
from tests.ledgers import event, raw, seal


def ledger(spark, size):
    start = {"runtimeId": "tester", "cwd": "/w/p", "machineId": "m1"}
    said = [event(n, "agent.output", {"text": str(n) * size}, tier="narration") for n in range(2, 10)]
    rows = seal([event(1, "session.start", start), *said, event(10, "session.end", {"exitCode": 0})])
    sessions = spark.createDataFrame(
        [("s1", 1, "tester", None, "2026-03-01T10:00:00.000Z", "2026-03-01T11:00:00.000Z", 0, "/w/p")], SESSIONS
    )
    return raw(spark, rows), sessions


def test_a_session_above_64_mib_has_its_record(spark):
    events, sessions = ledger(spark, 9 * 2**20)
    row = record.build_records(events, sessions, exact=False).select("status", F.octet_length("doc").alias("n")).first()
    assert row.status != "oversize" and row.n > 72 * 2**20


def test_sealing_keeps_to_the_bound_of_the_store(spark, tmp_path):
    events, sessions = ledger(spark, 10)
    small = ObjectStore(spark, str(tmp_path / "small"), max_bytes=100).add_sessions(events, sessions).first()
    assert (small.status, small.errors) == ("refused", ["session exceeds the ingestion bound of 100 bytes"])
    assert ObjectStore(spark, str(tmp_path / "any")).add_sessions(events, sessions).first().status == "added"
