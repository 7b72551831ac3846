"""Sealed records as rows: a header per session and its text in parts.

A record's canonical text is the same as that of ``record.build_records``, but it is never
one value: its facts and events stay rows of their own.  The content address is folded over
the parts as they stream by in order, so a session of any length is sealed and checked in
the memory of one Arrow batch, and the text is spelled out only where somebody asks for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.facts import evaluate
from ledgerlens.operators.record import header_columns, passages_of, prepared, session_parts, fact_json
from ledgerlens.settings import DEFAULT_PRODUCER, Producer, settle

# Sections of a record's text, in its order.  Rows of a list section are joined by commas.
OPENING, FACTS, MIDDLE, EVENTS, CLOSING, SUBJECT = range(6)
LISTS = (FACTS, EVENTS)
#: Within a section: facts by time, id and tie, events by number; nulls come first.
ORDER = ["section", "ts", "fact_id", "number", "text"]
PARTS = "session_id string, section int, ts string, fact_id string, number bigint, text string"


def sealed_rows(
    raw: DataFrame, sessions: DataFrame, producer: Producer = DEFAULT_PRODUCER, exact: bool = True, facts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A16 without a bound: headers with the content address, and the parts of all records.

    Headers: ``session_id, session_number, status, chain_head, event_count, fact_count, ended_at,
    record_id, bytes``, where ``bytes`` is the length of the whole text with its address in it.
    """
    docs, view, sizes = prepared(raw, producer, exact)
    fact_rows = settle(evaluate(view) if facts is None else facts, "sealed-facts")
    counts = fact_rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("fact_count"))
    own = session_parts(raw, view, sizes, sessions, producer, exact)
    said = passages_of(producer)
    heads = settle(reduce(lambda a, b: a.join(b, "session_id", "left"), [*own, counts]).select(
        *header_columns(said), F.concat(F.lit("{"), said["before_facts"]).alias("opening"), said["before_events"].alias("middle"),
        F.concat(said["after_events"], F.lit(",")).alias("closing"), F.concat(said["subject"], F.lit("}")).alias("end"),
    ), "sealed-heads")

    def rows(df, section, text, ts=None, fact_id=None, number=None):
        null = lambda c, kind: (F.lit(None) if c is None else F.col(c)).cast(kind)
        return df.select(
            "session_id", F.lit(section).alias("section"), null(ts, "string").alias("ts"), null(fact_id, "string").alias("fact_id"),
            null(number, "bigint").alias("number"), text.alias("text"),
        )

    listed = heads.select("session_id")
    parts = reduce(DataFrame.unionByName, [
        rows(heads, OPENING, F.col("opening")), rows(heads, MIDDLE, F.col("middle")), rows(heads, CLOSING, F.col("closing")),
        rows(heads, SUBJECT, F.col("end")),
        rows(fact_rows.join(listed, "session_id", "left_semi"), FACTS, fact_json(), "ts", "fact_id", "tie"),
        rows(docs.join(listed, "session_id", "left_semi"), EVENTS, F.col("json"), number="seq"),
    ])
    parts = settle(parts, "sealed-parts")
    headers = heads.drop("opening", "middle", "closing", "end").join(addresses(parts), "session_id")
    return headers, parts


def addresses(parts: DataFrame) -> DataFrame:
    """``session_id, record_id, bytes``: the SHA-256 of each record's text, folded over its parts in order."""
    names = ["session_id", "record_id", "bytes"]
    extra = len(f'"recordId":"{"0" * 64}",')

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told, size, before, begun = None, hashlib.sha256(), 0, None, False
        for batch in batches:
            done = []
            for session, section, text in zip(*(batch.column(c).to_pylist() for c in ("session_id", "section", "text"))):
                if not begun or session != key:
                    if begun:
                        done.append((key, told.hexdigest(), size + extra))
                    key, told, size, before, begun = session, hashlib.sha256(), 0, None, True
                said = (("," if section in LISTS and section == before else "") + (text or "")).encode()
                told.update(said)
                size, before = size + len(said), section
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done])
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (key, told.hexdigest(), size + extra)))])

    ordered = parts.repartition("session_id").sortWithinPartitions("session_id", *ORDER)
    return ordered.select("session_id", "section", "text").mapInArrow(fold, "session_id string, record_id string, bytes bigint")


def checked_rows(headers: DataFrame, parts: DataFrame) -> DataFrame:
    """Every header with what its parts hash to: ``session_id, record_id, actual_id, verdict``.

    ``verified``, ``altered`` where the address differs, ``missing`` where no part is there.
    """
    found = addresses(parts).select("session_id", F.col("record_id").alias("actual_id"))
    verdict = (
        F.when(F.col("actual_id").isNull(), "missing").when(F.col("actual_id") == F.col("record_id"), "verified").otherwise("altered")
    )
    return headers.join(found, "session_id", "left").select("session_id", "record_id", "actual_id", verdict.alias("verdict"))


def spelled_out(headers: DataFrame, parts: DataFrame) -> DataFrame:
    """``session_id, record_id, doc`` for export: each record as one value, which it must fit."""
    each = F.struct(*ORDER)
    texts = F.transform(
        F.array_sort(F.collect_list(each)), lambda x: F.struct(x["section"].alias("section"), x["text"].alias("text"))
    )
    held = parts.groupBy("session_id").agg(texts.alias("texts"))

    def section(n):
        mine = F.transform(F.filter("texts", lambda x: x["section"] == n), lambda x: x["text"])
        return F.array_join(mine, "," if n in LISTS else "")

    before = F.concat(*[section(n) for n in (OPENING, FACTS, MIDDLE, EVENTS, CLOSING)])
    return headers.join(held, "session_id").select(
        "session_id", "record_id",
        F.concat(before, F.lit('"recordId":"'), "record_id", F.lit('",'), section(SUBJECT)).alias("doc"),
    )


class RowStore:
    """A write-once store of records in rows: headers and parts by the prefix of the content address."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def headers(self) -> DataFrame:
        return self._read(
            "headers", "record_id string, session_id string, session_number bigint, status string, chain_head string, "
            "event_count bigint, fact_count bigint, ended_at string, bytes bigint, prefix string",
        )

    def parts(self) -> DataFrame:
        return self._read("parts", f"record_id string, {PARTS}, prefix string")

    def add_sessions(
        self, raw: DataFrame, sessions: DataFrame, include_open: bool = False, producer: Producer = DEFAULT_PRODUCER, exact: bool = True,
    ) -> DataFrame:
        """Seal closed sessions; ``source, status, object_id`` with ``added``, ``duplicate`` or ``skipped-open``.

        Parts are written before headers, so a run that is stopped leaves no header without its text.
        """
        wanted = sessions if include_open else sessions.where(F.col("ended_at").isNotNull())
        events = raw.join(wanted.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        headers, parts = sealed_rows(events, wanted, producer, exact)
        headers = settle(headers, "row-headers")
        held = settle(self.headers().select("record_id").distinct(), "row-held")
        new = headers.join(held, "record_id", "left_anti")
        prefix = F.substring("record_id", 1, 2).alias("prefix")
        ids = new.select("session_id", "record_id")
        for name, rows in (("parts", parts.join(ids, "session_id")), ("headers", new)):
            columns = self.parts().columns if name == "parts" else self.headers().columns
            rows.select(*[c for c in columns if c != "prefix"], prefix).write.mode("append").partitionBy("prefix").parquet(f"{self.root}/{name}")
        source = lambda c: F.concat(F.lit("session #"), F.col(c).cast("string")).alias("source")
        told = headers.join(held.withColumn("old", F.lit(True)), "record_id", "left").select(
            source("session_number"), F.when(F.col("old"), "duplicate").otherwise("added").alias("status"), F.col("record_id").alias("object_id")
        )
        skipped = sessions.join(wanted.select("id"), "id", "left_anti").select(
            source("number"), F.lit("skipped-open").alias("status"), F.lit(None).cast("string").alias("object_id")
        )
        return told.unionByName(skipped)

    def read(self, record_id: str) -> tuple[DataFrame, DataFrame]:
        """Header and parts of one record; only its prefix is read."""
        mine = (F.col("prefix") == record_id[:2]) & (F.col("record_id") == record_id)
        return self.headers().where(mine), self.parts().where(mine)

    def verify(self) -> DataFrame:
        """Every stored record against its parts."""
        return checked_rows(self.headers(), self.parts())
