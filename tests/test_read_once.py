"""Documents are parsed once, whole rows pass the chain's fold, and streams call Python once per group of paths."""

from pyspark.sql import functions as F

from ledgerlens.llm import chat
from ledgerlens.operators import chain, record
from ledgerlens.streaming import ingest


def test_the_chain_is_folded_in_one_pass(spark):
    rows = [(f"e{i}", f"s{i % 3}" if i % 5 else None, None if i == 7 else f"2024-01-01T00:00:{i % 50:02d}.000Z") for i in range(60)]
    drafts = spark.createDataFrame(rows, "id string, session_id string, ts string")
    drafts = drafts.select(*[
        F.col(c) if c in drafts.columns else F.lit('{"a":1}' if c == "payload" else None).cast(
            {"monotonic_ts": "bigint", "reversible": "boolean", "taint": "boolean"}.get(c, "string")).alias(c)
        for c in chain.DRAFT_COLUMNS
    ])
    sealed = chain.build_chain(drafts, exact=False)
    assert sealed._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sealed.count() == 60
    got = {}
    for r in sealed.collect():
        got.setdefault(r.session_id, []).append((r.seq, r.ts is None, r.ts or "", r.id))
    for events in got.values():
        assert [e[0] for e in sorted(events)] == [*range(1, len(events) + 1)]
        assert [e[1:] for e in sorted(events)] == sorted(e[1:] for e in events)
    assert all(r.intact for r in chain.verify_chain(sealed.where("session_id is not null"), exact=False).collect())


def test_documents_are_read_once(spark):
    docs = spark.createDataFrame(
        [("a", '{"recordId":"x","n":1}'), ("b", '{"recordId":"x","n":1e400}'), ("c", "{not json"), ("d", None), ("e", '{"n":2e1,"n":1}')],
        "source string, doc string",
    )
    read = record.read_objects(docs)
    assert {r.source for r in read.even.collect()} == {"a"}
    assert {r.source for r in read.odd.collect()} == {"b", "c", "d", "e"}
    texts = {r.source: r.doc for r in read.texts().collect()}
    assert texts["a"] == '{"n":1,"recordId":"x"}' and texts["c"] is None and texts["e"] == '{"n":1}'
    checked = record.check_records(docs)
    assert checked.count() == 5 and {r.verdict for r in checked.collect()} == {"invalid"}
    # The text of a document is parsed in no step behind the one that read it.
    assert "parse_json" not in record.check_read(record.ReadObjects(read.even, None))._jdf.queryExecution().optimizedPlan().toString()


def test_paths_share_groups_of_a_stream(spark, tmp_path):
    writes = spark.range(3000).select(
        F.concat(F.lit("s"), F.col("id") % 7).alias("session_id"), F.concat(F.lit("p"), F.col("id")).alias("path"),
        F.col("id").cast("string").alias("id"), (F.col("id") + 1).alias("ts_ms"), F.lit("a").alias("before_ref"), F.lit("b").alias("after_ref"),
    )
    end = spark.createDataFrame([("end", "end", "end", 10_000_000, "a", "b")], writes.schema)
    for n, rows in enumerate((writes, end)):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.settled_writes(spark.readStream.schema(writes.schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        if n == 0:
            assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= ingest.WRITE_BUCKETS
    assert spark.read.parquet(f"{tmp_path}/out").where("session_id <> 'end'").count() == 3000


def test_a_wrong_mark_is_found_at_any_length(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHECKED_CHARS", 100)
    turns = [("user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(60)]
    df = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    numbered = chat.by_turn(lambda m: "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(m)))
    assert [r.formatted for r in chat.format_conversations(df, numbered).collect()] == [numbered(turns)]
    honest = chat.by_turn(lambda m: "".join(f"{r}:{t};" for r, t in m))
    rows = chat.format_conversations(df, honest).orderBy("segment").collect()
    assert [r.turns for r in rows] == [32, 28] and "".join(r.formatted for r in rows) == honest(turns)
