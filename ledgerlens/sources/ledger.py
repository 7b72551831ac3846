"""Ledger scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_events(
    events: DataFrame, session_id: str | None = None, tier: str | None = None,
    kinds: str | Sequence[str] | None = None, file: str | None = None,
    since: str | None = None, until: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Filtered events in (session, seq) order.

    ``file`` is a LIKE pattern looked for anywhere in the resolved path, without
    regard to ASCII case; ``%`` and ``_`` in it keep their meaning.
    """
    out = events
    if session_id:
        out = out.where(F.col("session_id") == session_id)
    if tier:
        out = out.where(F.col("signal_tier") == tier)
    if kinds:
        out = out.where(F.col("kind").isin([kinds] if isinstance(kinds, str) else list(kinds)))
    if file:
        fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        pattern = "".join(c.lower() if c.isascii() else c for c in f"%{file}%").replace("\\", "\\\\")
        out = out.where(fold(F.col("path")).like(pattern))
    if since:
        out = out.where(F.col("ts") >= since)
    if until:
        out = out.where(F.col("ts") <= until)
    out = out.orderBy("session_id", "seq")
    if limit is None:
        return out
    if limit < 1:
        raise ValueError("limit must be a positive number")
    return out.limit(limit)


def session_by_number(sessions: DataFrame, number: int) -> DataFrame:
    return sessions.where(F.col("number") == number)


def list_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """S3: sessions, newest number first; the newest ``limit`` of them where it is given."""
    newest = sessions.orderBy(F.desc("number"))
    return newest if limit is None else newest.limit(limit)


def latest_session(sessions: DataFrame) -> DataFrame:
    return list_sessions(sessions, 1)


def open_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions without an end, and when something was last heard of them."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last_event_at"))
    return sessions.where(F.col("ended_at").isNull()).join(
        last, sessions["id"] == last["session_id"], "left"
    ).drop("session_id")
