"""Session status with the default quiet time: a session that goes on after a long silence."""

from ledgerlens.plans.queries_stream import run_arrivals
from ledgerlens.streaming import ingest

HOUR = 3_600_000
START = 1_772_359_200_000


def test_a_session_that_goes_on_after_an_hour_is_stale_and_then_closed(spark):
    made = lambda *rows: spark.createDataFrame(list(rows), "session_id string, kind string, ts_ms long")
    arrivals = [
        made(("gap", "session.start", START), ("short", "session.start", START), ("short", "file.read", START + HOUR // 2)),
        made(("short", "session.end", START + HOUR), ("other", "session.start", START + 3 * HOUR)),
        made(("gap", "session.end", START + 4 * HOUR)),
        made(("end", "session.end", START + 100 * HOUR)),
    ]
    rows = sorted((r.session_id, r.last_ms, r.status) for r in run_arrivals(spark, "quiet", arrivals, ingest.session_status).collect())
    assert rows == [
        ("gap", START, "stale"), ("gap", START + 4 * HOUR, "closed"), ("other", START + 3 * HOUR, "stale"), ("short", START + HOUR, "closed"),
    ]
