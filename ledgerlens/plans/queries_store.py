"""Queries that check, extract, store and exchange record documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.operators import links, record, record_rows
from ledgerlens.operators.identity import resolve
from ledgerlens.plans import bridge, extract
from ledgerlens.plans.oracle import with_base
from ledgerlens.plans.queries_graph import IDENTITY_SQL
from ledgerlens.plans.queries_ledger import RAW_SQL, SESSIONS_SQL
from ledgerlens.plans.queries_report import RECORDS, VIEW_SQL, built_records, sealed
from ledgerlens.plans.register import query
from ledgerlens.settings import checkpoint_root, settle, settle_texts
from ledgerlens.sources.objects import ObjectStore, classify_paths, union_stores, verify_objects


def documents(spark, sf_dir):
    """``source, doc, u`` of every sealed session."""
    built = built_records(spark, sf_dir).where(F.col("doc").isNotNull())
    return settle_texts(built.select(
        F.col("session_id").alias("source"), "doc", F.col("session_number").alias("u"), "record_id"
    ), "documents")


def damaged(docs):
    """One kind of damage for every seventh of the sessions."""
    u = F.col("u")
    doc = (
        F.when(u % 7 == 1, F.replace("doc", F.lit('"status":"DEGRADED"'), F.lit('"status":"VERIFIED"')))
        .when(u % 7 == 2, F.replace("doc", F.lit('"formatVersion":1'), F.lit('"formatVersion":2')))
        .when(u % 7 == 3, F.lit("{not json"))
        .when(u % 7 == 4, F.replace("doc", F.lit('"subject":'), F.lit('"sub":')))
        .when(u % 7 == 5, F.replace("doc", F.lit("git push --force"), F.lit("git push")))
        .otherwise(F.col("doc"))
    )
    return docs.select("source", doc.alias("doc"))


DAMAGE = """ SELECT session_id AS source, CASE WHEN u%7 IN (2,3,4) THEN 'invalid'
   WHEN (u%7=1 AND status='DEGRADED') OR (u%7=5 AND contains(head_part,'git push --force')) THEN 'altered' ELSE 'verified' END AS verdict,
   CASE WHEN u%7 IN (2,3,4) THEN 1 WHEN u%7=1 AND status='DEGRADED' THEN 2
     WHEN u%7=5 AND contains(head_part,'git push --force') THEN CASE WHEN contains(split_part(head_part,'"observations":',2),'git push --force') THEN 3 ELSE 1 END ELSE 0 END::BIGINT AS n_errors
 FROM (SELECT *, session_number AS u FROM recs)"""


@query("p8_check_records", RECORDS + DAMAGE)
def p8_check_records(spark, sf_dir):
    """Every sealed record, most of them damaged in one way or another."""
    return record.check_records(damaged(documents(spark, sf_dir))).select(
        "source", "verdict", F.size("errors").cast("bigint").alias("n_errors")
    )


@query("q11_verify_store", RECORDS + """ SELECT count(*) AS record_count, 0::BIGINT AS link_count, false AS store_intact, count(*) FILTER (status='DEGRADED' AND session_number%6<>1) AS degraded_records, 0::BIGINT AS dangling_links FROM recs""")
def q11_verify_store(spark, sf_dir):
    """Records of every sixth session are filed under another's name."""
    docs = documents(spark, sf_dir)
    filed = docs.select(
        "source", "doc", F.when(F.col("u") % 6 == 1, F.sha2(F.col("record_id").cast("binary"), 256))
        .otherwise(F.col("record_id")).alias("filed_id"),
    )
    none = spark.createDataFrame([], "source string, filed_id string, doc string")
    _, summary = verify_objects(filed, none)
    return summary.select("record_count", "link_count", "store_intact", "degraded_records", "dangling_links")


@query("s15_records", RECORDS + """ SELECT session_id, record_id, chain_head, event_count, fact_count, status AS integrity_status FROM recs""")
def s15_records(spark, sf_dir):
    tables = extract.extract(documents(spark, sf_dir).select("source", "doc"))
    return tables.records.select(
        "session_id", "record_id", "chain_head", "event_count", "fact_count", "integrity_status"
    )


@query("s15_file_events", with_base(RAW_SQL, VIEW_SQL) + """ SELECT session_id, seq, kind, path AS abs_path, CASE WHEN in_scope THEN substr(path, length('/w/r'||(user_id%12))+2) END AS rel_path, in_scope,
   CASE WHEN mtime_ms IS NOT NULL THEN strftime(make_timestamp(mtime_ms*1000),'%Y-%m-%dT%H:%M:%S.%gZ') ELSE ts END AS occurred_ts, content_withheld FROM gv WHERE kind IN ('file.write','file.delete')""")
def s15_file_events(spark, sf_dir):
    tables = extract.extract(documents(spark, sf_dir).select("source", "doc"))
    return tables.file_events.join(tables.records.select("record_id", "session_id"), "record_id").select(
        "session_id", "seq", "kind", "abs_path", "rel_path", "in_scope", "occurred_ts", "content_withheld"
    )


@query("s15_signals", with_base(RAW_SQL, VIEW_SQL, SESSIONS_SQL) + """,
 st AS (SELECT session_id, user_id FROM gv WHERE kind='session.start'),
 o AS (SELECT session_id, CASE WHEN user_id%4=3 THEN 'github.com:8443' ELSE 'github.com' END||'/acme/r'||(user_id%12) AS origin FROM st WHERE user_id%5<>0)
 SELECT session_id, 'origin' AS kind, origin AS value FROM o UNION ALL SELECT session_id, 'remote', origin FROM o
 UNION ALL SELECT session_id, 'root', 'root'||(user_id%9) FROM st WHERE user_id%7<>0""")
def s15_signals(spark, sf_dir):
    tables = extract.extract(documents(spark, sf_dir).select("source", "doc"))
    return tables.signals.join(tables.records.select("record_id", "session_id"), "record_id").select(
        "session_id", "kind", "value"
    )


@query("s15_facts", RECORDS + """ SELECT session_id, fact_id, statement, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, fact_id, tie)-1 AS ord FROM vf""")
def s15_facts(spark, sf_dir):
    tables = extract.extract(documents(spark, sf_dir).select("source", "doc"))
    return tables.facts.join(tables.records.select("record_id", "session_id"), "record_id").select(
        "session_id", "fact_id", "statement", "ts", F.col("ord").cast("bigint").alias("ord")
    )


# Repositories of sealed records; a session without a readable start has neither machine, remotes nor roots.
RESOLVED = RECORDS + """, st AS (SELECT DISTINCT session_id FROM gv WHERE kind='session.start'),
 rec AS (SELECT r.record_id, r.session_id, r.chain_head, s.runtime_id, s.started_at, s.cwd, CASE WHEN st.session_id IS NOT NULL THEN 'm'||(number%20) END AS machine_id,
   CASE WHEN st.session_id IS NOT NULL AND number%5<>0 THEN CASE WHEN number%4=3 THEN 'github.com:8443' ELSE 'github.com' END||'/acme/r'||(number%12) END AS origin,
   CASE WHEN origin IS NULL THEN [] ELSE [origin] END AS remotes,
   CASE WHEN st.session_id IS NOT NULL AND number%7<>0 THEN ['root'||(number%9)] ELSE [] END AS roots,
   substr(sha256(coalesce(machine_id,'unknown')||chr(0)||s.cwd),1,16) AS path_key
   FROM recs r JOIN s ON s.id=r.session_id LEFT JOIN st ON st.session_id=r.session_id),
 dirs AS (SELECT '' AS kind, '' AS a, '' AS b, '' AS link_id, '' AS author WHERE false),""" + IDENTITY_SQL


@query("s15_resolved_repos", RESOLVED + " SELECT display_name, basis, session_count FROM grp")
def s15_resolved_repos(spark, sf_dir):
    """From documents to repositories: those known by origin, by root commit and by path alone."""
    tables = extract.extract(documents(spark, sf_dir).select("source", "doc"))
    return resolve(tables.evidence).groups.select("display_name", "basis", "session_count")


def new_store(spark, name):
    return ObjectStore(spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}")


@query("s8_s11_seal_sessions", RECORDS + """ SELECT 'session #'||session_number AS source, CASE WHEN ended_at IS NULL THEN 'skipped-open' ELSE 'added' END AS status,
   CASE WHEN ended_at IS NOT NULL THEN record_id END AS object_id FROM recs""")
def s8_s11_seal_sessions(spark, sf_dir):
    """Backfill of a new store: closed sessions are sealed, open ones skipped."""
    sessions = bridge.ledger_sessions(spark, sf_dir).drop("first_ms", "last_ms")
    store = new_store(spark, "store")
    return store.add_sessions(sealed(spark, sf_dir), sessions, exact=False).select("source", "status", "object_id")


@query("s8_add_records", RECORDS + """ SELECT d.session_id AS source, CASE WHEN v.verdict<>'verified' THEN 'refused' WHEN d.session_number%2=0 THEN 'duplicate' ELSE 'added' END AS status
 FROM recs d JOIN (""" + DAMAGE + """) v ON v.source=d.session_id""")
def s8_add_records(spark, sf_dir):
    """A second add over a store that already has every even session."""
    docs = documents(spark, sf_dir)
    store = new_store(spark, "store")
    store.add_records(damaged(docs.where(F.col("u") % 2 == 0)))
    return store.add_records(damaged(docs)).select("source", "status")


@query("s12_union_stores", RECORDS + """ SELECT record_id AS object_id, CASE WHEN session_number%3=0 THEN 'push' ELSE 'pull' END AS direction, 'added' AS status
 FROM recs WHERE session_number%3<>1""")
def s12_union_stores(spark, sf_dir):
    """Two overlapping stores after one exchange."""
    docs = documents(spark, sf_dir)
    here, there = new_store(spark, "here"), new_store(spark, "there")
    here.add_records(docs.where(F.col("u") % 3 != 2).select("source", "doc"))
    there.add_records(docs.where(F.col("u") % 3 != 0).select("source", "doc"))
    return union_stores(here, there).select("object_id", "direction", "status")


@query("s6_s9_links", with_base(SESSIONS_SQL) + """ SELECT count(*) FILTER (number%10 IN (3,4,5,6)) AS added, count(*) FILTER (number%10 IN (3,4,5,6)) AS readable, 0::BIGINT AS unreadable FROM s""")
def s6_s9_links(spark, sf_dir):
    made = links.make_links(bridge.claims(spark, sf_dir))
    store = new_store(spark, "links")
    added = store.add_links(made.select(F.col("link_id").alias("source"), "doc"))
    readable, unreadable = store.read_links()
    one = F.lit(1).alias("k")
    counts = added.agg(F.count_if(F.col("status") == "added").alias("added")).select("added", one)
    read = readable.agg(F.count(F.lit(1)).alias("readable")).select("readable", one)
    return counts.join(read, "k").join(unreadable.select("unreadable", one), "k").drop("k")


@query("s16_read_record", RECORDS + " SELECT record_id AS source, sha256('{'||head_part||',\"recordId\":\"'||record_id||'\",'||subject||'}') AS doc_hash FROM recs ORDER BY session_number DESC LIMIT 1")
def s16_read_record(spark, sf_dir):
    """One record by id, from its partition of the store, checked again."""
    docs = documents(spark, sf_dir)
    store = new_store(spark, "store")
    store.add_records(docs.select("source", "doc"))
    wanted = docs.orderBy(F.desc("u")).first()["record_id"]
    return store.read("record", wanted).select(
        "source", F.sha2(F.col("doc").cast("binary"), 256).alias("doc_hash")
    )


@query("s7_store_walk", """ WITH n AS (SELECT event_id, sha256(event_id::VARCHAR) AS h FROM events)
 SELECT event_id, CASE event_id%4 WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'temp' ELSE 'stray' END AS path_class,
   CASE event_id%4 WHEN 0 THEN 'record' WHEN 1 THEN 'link' END AS kind, CASE WHEN event_id%4<2 THEN h END AS filed_id FROM n""")
def s7_store_walk(spark, sf_dir):
    h = F.sha2(F.col("event_id").cast("string").cast("binary"), 256)
    at = F.concat(F.lit("/store/records/"), F.substring(h, 1, 2), F.lit("/"))
    e = F.col("event_id")
    path = (
        F.when(e % 4 == 0, F.concat(at, h, F.lit(".record.json")))
        .when(e % 4 == 1, F.concat(at, h, F.lit(".link.json")))
        .when(e % 4 == 2, F.concat(at, F.lit(".tmp-"), h)).otherwise(F.concat(at, F.lit("notes.txt")))
    )
    files = bridge.load(spark, sf_dir, "events").select("event_id", path.alias("path"))
    return classify_paths(files).select("event_id", "path_class", "kind", "filed_id")


# ---- records in rows -----------------------------------------------------------------

def row_store(spark):
    return record_rows.RowStore(spark, f"{checkpoint_root(spark)}/rows-{uuid.uuid4().hex}")


@query("a16_sealed_rows", RECORDS + """
 SELECT session_id, session_number, status, chain_head, event_count, fact_count, record_id,
   octet_length(encode('{'||head_part||',"recordId":"'||record_id||'",'||subject||'}'))::BIGINT AS bytes FROM recs""")
def a16_sealed_rows(spark, sf_dir):
    """Records whose events stay rows: the same addresses as those of whole texts."""
    sessions = bridge.ledger_sessions(spark, sf_dir).drop("first_ms", "last_ms")
    headers, _ = record_rows.sealed_rows(sealed(spark, sf_dir), sessions, exact=False)
    return headers.select(
        "session_id", "session_number", "status", "chain_head", "event_count",
        F.col("fact_count").cast("bigint").alias("fact_count"), "record_id", "bytes",
    )


@query("s8_row_store", RECORDS + """ SELECT 'session #'||session_number AS source, run, CASE WHEN ended_at IS NULL THEN 'skipped-open' WHEN run=1 OR session_number%2=1 THEN 'added' ELSE 'duplicate' END AS status,
   CASE WHEN ended_at IS NOT NULL THEN record_id END AS object_id FROM recs, (VALUES (1),(2)) AS r(run) WHERE run=2 OR session_number%2=0""")
def s8_row_store(spark, sf_dir):
    """Sealing into a store of rows twice, the second time with all sessions."""
    sessions = settle(bridge.ledger_sessions(spark, sf_dir).drop("first_ms", "last_ms"), "row-sessions")
    raw = sealed(spark, sf_dir)
    store = row_store(spark)
    first = sessions.where(F.col("number") % 2 == 0)
    own = raw.join(first.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    one = settle(store.add_sessions(own, first, exact=False), "row-first")
    two = store.add_sessions(raw, sessions, exact=False)
    return one.withColumn("run", F.lit(1)).unionByName(two.withColumn("run", F.lit(2)))


@query("p8_check_rows", RECORDS + """ SELECT session_id, CASE WHEN session_number%7=3 THEN 'missing'
   WHEN session_number%7=5 AND contains(split_part(head_part,'"observations":',2),'git push --force') THEN 'altered' ELSE 'verified' END AS verdict FROM recs""")
def p8_check_rows(spark, sf_dir):
    """Parts of some records are changed or gone."""
    sessions = bridge.ledger_sessions(spark, sf_dir).drop("first_ms", "last_ms")
    headers, parts = record_rows.sealed_rows(sealed(spark, sf_dir), sessions, exact=False)
    number = headers.select("session_id", "session_number")
    u = F.col("session_number") % 7
    text = F.when((u == 5) & (F.col("section") == record_rows.EVENTS), F.replace("text", F.lit("git push --force"), F.lit("git push")))
    damaged_parts = parts.join(number, "session_id").where(u != 3).withColumn("text", F.coalesce(text, "text")).drop("session_number")
    return record_rows.checked_rows(headers, damaged_parts).select("session_id", "verdict")
