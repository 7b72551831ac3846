"""Queries over the ledger: facts, history, clocks and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import chain, facts
from ledgerlens.operators.ancestry import Ancestry
from ledgerlens.operators.ordered import ordered_view
from ledgerlens.plans import bridge
from ledgerlens.plans.oracle import CLOCK, FACTS, RF, RF01_FAILED, with_base
from ledgerlens.plans.register import query
from ledgerlens.settings import settle
from ledgerlens.sources.ledger import latest_session, list_sessions, open_sessions, scan_events


def ledger(spark, sf_dir):
    """The bridged ledger, written once because several operators read it."""
    return settle(bridge.ledger_events(spark, sf_dir), "ledger")


def flat(rows):
    """Facts with their citations as one text."""
    return rows.select(
        "session_id", "fact_id", "statement", "ts", F.col("tie").cast("bigint").alias("tie"),
        F.array_join("evidence.eventId", ",").alias("cited"),
    )


_NEEDS = {"RF-01": (RF01_FAILED,), "RF-04": (CLOCK,)}


def _register_fact(fact_id, fn):
    name = fact_id.replace("-", "").lower()
    sql = with_base(*_NEEDS.get(fact_id, ())) + " " + RF[fact_id]

    @query(name, sql)
    def run(spark, sf_dir):
        source = ledger if fact_id in _NEEDS else bridge.ledger_events
        return flat(fn(source(spark, sf_dir)))

    run.__doc__ = f"{fact_id} over the whole ledger."


for _id, _fn in facts.FACTS.items():
    _register_fact(_id, _fn)


@query("rf03_by_day", with_base(
    "d AS (SELECT * REPLACE (concat(session_id,'/',substr(ts,1,10)) AS session_id) FROM gt)"
) + " " + RF["RF-03"].replace("FROM gt GROUP BY", "FROM d GROUP BY"))
def rf03_by_day(spark, sf_dir):
    """RF-03 with one session per user and day, which is where it fires."""
    e = bridge.ledger_events(spark, sf_dir)
    day = F.concat("session_id", F.lit("/"), F.substring("ts", 1, 10))
    return flat(facts.rf03(e.withColumn("session_id", day)))


@query("rf_all", with_base(FACTS) + " SELECT * FROM facts")
def rf_all(spark, sf_dir):
    """RF-ALL: every fact of every session."""
    return flat(facts.evaluate(ledger(spark, sf_dir)))


@query("rf_all_ordered", with_base(FACTS) + """
 SELECT session_id, fact_id, statement, ts, cited,
   row_number() OVER (PARTITION BY session_id ORDER BY ts, fact_id, tie) - 1 AS ord FROM facts""")
def rf_all_ordered(spark, sf_dir):
    """RF-ALL with the place of each fact in its session's report."""
    found = settle(facts.evaluate(ledger(spark, sf_dir)), "facts")
    return facts.with_ordinal(found).select(
        "session_id", "fact_id", "statement", "ts", F.array_join("evidence.eventId", ",").alias("cited"),
        F.col("ord").cast("bigint").alias("ord"),
    )


@query("a1_command_history", with_base() + """
 SELECT session_id, cwd, command AS key, count(*) AS runs, min(seq) AS first_seq,
   CASE WHEN max_by(coalesce(exit_code,-1),seq)=0 THEN 'pass' WHEN max_by(coalesce(exit_code,-1),seq)=-1 THEN 'none' ELSE 'fail' END AS last_verdict,
   max(seq) FILTER (exit_code<>0) AS failed_seq
 FROM gt WHERE kind='process.exit' GROUP BY session_id, cwd, command""")
def a1_command_history(spark, sf_dir):
    return facts.command_history(bridge.ledger_events(spark, sf_dir)).select(
        "session_id", "cwd", "key", "runs", "first_seq", "last_verdict",
        F.col("failed.seq").alias("failed_seq"),
    )


@query("j1_failing_ancestors", with_base(RF01_FAILED) + """
 SELECT session_id, seq, anc_exec AS ancestor FROM anc""")
def j1_failing_ancestors(spark, sf_dir):
    e = ledger(spark, sf_dir)
    failures = facts.command_history(e).where(F.col("failed").isNotNull()).select("session_id", "failed.*")
    return Ancestry(failures.select("session_id", "seq", "exec_id", "parent_exec_id"), facts.readable_exits(e)).descends()


@query("j1_deep_ancestors", """WITH r AS (SELECT concat('d',user_id%3) AS session_id, row_number() OVER (PARTITION BY user_id%3 ORDER BY event_id)-1 AS seq FROM events),
 f AS (SELECT session_id, seq FROM r WHERE seq%50=7)
 SELECT f.session_id, f.seq, 'x'||a.seq AS ancestor FROM f JOIN f a ON a.session_id=f.session_id AND a.seq<f.seq AND a.seq//1000=f.seq//1000""")
def j1_deep_ancestors(spark, sf_dir):
    """All events as process trees a thousand deep, in which every fiftieth command fails."""
    e = bridge.load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("session_id"))
    placed = ordered_view(e, ["session_id"], F.floor(F.col("event_id") / 4096).cast("bigint"), ["event_id"], position="n")
    seq = F.col("n") - 1
    name = lambda c: F.concat(F.lit("x"), c.cast("string"))
    exits = settle(placed.select(
        "session_id", seq.alias("seq"), name(seq).alias("exec_id"), F.when(seq % 1000 > 0, name(seq - 1)).alias("parent_exec_id")
    ), "deep-exits")
    return Ancestry(exits.where(F.col("seq") % 50 == 7), exits).descends()


@query("w2_clock_regression", with_base(CLOCK) + " SELECT session_id, at_seq, drift_ms FROM clock")
def w2_clock_regression(spark, sf_dir):
    return chain.clock_regression(bridge.ledger_events(spark, sf_dir))


@query("w3_content_first_seen", with_base() + """
 SELECT session_id, path, ref, min(seq) AS first_seq FROM (
   SELECT session_id, path, seq, after_ref AS ref FROM gt WHERE kind='file.write' AND in_scope AND after_ref IS NOT NULL
   UNION ALL SELECT session_id, path, seq, before_ref FROM gt WHERE kind='file.write' AND in_scope AND after_ref IS NOT NULL AND before_ref IS NOT NULL)
 GROUP BY session_id, path, ref""")
def w3_content_first_seen(spark, sf_dir):
    seen = facts.content_first_seen(bridge.ledger_events(spark, sf_dir))
    return seen.select("session_id", "path", "ref", "first_seq").distinct()


@query("w6_first_last_per_path", with_base() + """
 SELECT session_id, path, min_by(id,seq) AS first_id, max_by(id,seq) AS last_id FROM gt WHERE path IS NOT NULL GROUP BY session_id, path""")
def w6_first_last_per_path(spark, sf_dir):
    gt = facts.ground_truth(bridge.ledger_events(spark, sf_dir)).where(F.col("path").isNotNull())
    return gt.groupBy("session_id", "path").agg(
        F.min_by("id", "seq").alias("first_id"), F.max_by("id", "seq").alias("last_id")
    )


@query("s1_scan_events", with_base() + """
 SELECT id, session_id, seq, ts, kind, path FROM b WHERE signal_tier='groundTruth' AND kind IN ('file.write','file.delete')
   AND path ILIKE '%SRC/f_.py%' AND ts>='2024-01-05' AND ts<='2024-01-20'""")
def s1_scan_events(spark, sf_dir):
    return scan_events(
        bridge.ledger_events(spark, sf_dir), tier="groundTruth", kinds=["file.write", "file.delete"],
        file="SRC/f_.py", since="2024-01-05", until="2024-01-20",
    ).select("id", "session_id", "seq", "ts", "kind", "path")


@query("s1_scan_first_rows", with_base() + " SELECT id, session_id, seq FROM b ORDER BY session_id, seq LIMIT 500")
def s1_scan_first_rows(spark, sf_dir):
    """O2: the limit of a scan applies after its order."""
    return scan_events(bridge.ledger_events(spark, sf_dir), limit=500).select("id", "session_id", "seq")


SESSIONS_SQL = """
s AS (SELECT concat('u',user_id) AS id, user_id AS number,
  CASE user_id%3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'aider' END AS runtime_id,
  CASE WHEN user_id%2=0 THEN concat('fix issue ',user_id) END AS mission,
  strftime(make_timestamp(min(ms)*1000),'%Y-%m-%dT%H:%M:%S.%gZ') AS started_at,
  CASE WHEN user_id%4<>0 THEN strftime(make_timestamp(max(ms)*1000),'%Y-%m-%dT%H:%M:%S.%gZ') END AS ended_at,
  CASE WHEN user_id%4<>0 AND user_id%5<>0 THEN user_id%3 END AS exit_code,
  concat('/w/r',user_id%12) AS cwd, min(ms) AS first_ms, max(ms) AS last_ms FROM e GROUP BY user_id)"""


@query("s3_list_sessions", with_base(SESSIONS_SQL) + """
 SELECT id, number, runtime_id, mission, started_at, ended_at, exit_code, cwd FROM s ORDER BY number DESC LIMIT 50""")
def s3_list_sessions(spark, sf_dir):
    return list_sessions(bridge.ledger_sessions(spark, sf_dir), 50).drop("first_ms", "last_ms")


@query("o3_latest_session", with_base(SESSIONS_SQL) + " SELECT id, number FROM s ORDER BY number DESC LIMIT 1")
def o3_latest_session(spark, sf_dir):
    return latest_session(bridge.ledger_sessions(spark, sf_dir)).select("id", "number")


@query("p13_open_sessions", with_base(SESSIONS_SQL) + """
 SELECT s.id, s.number, max(b.ts) AS last_event_at FROM s JOIN b ON b.session_id=s.id WHERE s.ended_at IS NULL GROUP BY s.id, s.number""")
def p13_open_sessions(spark, sf_dir):
    return open_sessions(
        bridge.ledger_sessions(spark, sf_dir), bridge.ledger_events(spark, sf_dir)
    ).select("id", "number", "last_event_at")


# ---- chains -------------------------------------------------------------------------

RAW_SQL = """
kn AS (SELECT *, CASE WHEN seq=1 THEN 'session.start' WHEN seq=session_rows AND user_id%4<>0 THEN 'session.end'
   WHEN kind='file.read' AND k%8=1 THEN 'agent.output' ELSE kind END AS rkind,
   CASE user_id%3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'aider' END AS runtime_id,
   CASE WHEN user_id%5=0 THEN NULL ELSE CASE user_id%4 WHEN 0 THEN concat('https://GitHub.com/acme/r',user_id%12,'.git')
     WHEN 1 THEN concat('git@github.com:acme/r',user_id%12,'.git') WHEN 2 THEN concat('ssh://git@github.com:22/acme/r',user_id%12)
     ELSE concat('https://u:t@github.com:8443/acme/r',user_id%12,'/') END END AS origin_url FROM b),
r AS (SELECT *,
   CASE WHEN rkind='session.start' THEN '{"cwd":"/w/r'||(user_id%12)||'","gitRemotes":['||coalesce('{"name":"origin","url":"'||origin_url||'"}','')||'],"gitRootCommits":['||
       CASE WHEN user_id%7=0 THEN '' ELSE '"root'||(user_id%9)||'"' END||'],"machineId":"m'||(user_id%20)||'","runtimeId":"'||runtime_id||'"}'
     WHEN rkind='session.end' THEN '{"durationMs":'||monotonic_ms||',"exitCode":'||CASE WHEN user_id%5<>0 THEN CAST(user_id%3 AS VARCHAR) ELSE 'null' END||'}'
     WHEN rkind='agent.output' THEN CASE k%3 WHEN 0 THEN '{"coverageProbe":{"commands":[{"command":"npm","status":"observed"},{"command":"git","status":"'||CASE WHEN k%2=0 THEN 'shadowed' ELSE 'unknown' END||'"}]}}'
       WHEN 1 THEN '{"recorder":"fs","recorderError":"limit '||k||'"}' ELSE '{"command":"npm","ledgerlensInterference":true,"reason":"loop"}' END
     WHEN rkind='process.exit' THEN '{"command":"'||command||'","cwd":"'||cwd||'","execId":"'||exec_id||'","exitCode":'||coalesce(CAST(exit_code AS VARCHAR),'null')||
       coalesce(',"parentExecId":"'||parent_exec_id||'"','')||coalesce(',"signal":"'||signal||'"','')||'}'
     WHEN rkind='git.status' THEN '{"branch":"main","dirtyAtEnd":'||CASE WHEN NOT dirty_known THEN 'null' WHEN dirty_count=0 THEN '[]' WHEN dirty_count=1 THEN '["src/a.py"]' ELSE '["src/a.py","src/b.py"]' END||'}'
     ELSE '{'||CASE WHEN rkind='file.write' AND after_ref IS NULL THEN '"contentWithheld":"oversized",' ELSE '' END||coalesce('"mtimeMs":'||mtime_ms||',','')||'"path":"'||path||'"}' END AS payload,
   CASE WHEN rkind IN ('file.write','file.delete','file.read') THEN '{"inScope":'||CASE WHEN in_scope THEN 'true' ELSE 'false' END||',"kind":"file","raw":"'||path||'","resolved":"'||path||'"}' END AS target,
   CASE WHEN rkind='file.write' AND (after_ref IS NOT NULL OR before_ref IS NOT NULL) THEN '{'||concat_ws(',','"after":"'||after_ref||'"','"before":"'||before_ref||'"')||'}' END AS snapshot_ref,
   '{"kind":"agent","runtimeId":"'||runtime_id||'"}' AS actor FROM kn),
body AS (SELECT *, '{"actor":'||actor||',"blastRadius":null,"effectClass":null,"id":"'||id||'","kind":"'||rkind||'","missionId":null,"monotonicTs":'||monotonic_ms||',"payload":'||payload||',"prevHash":"' AS h,
   '","reversible":null,"seq":'||seq||',"sessionId":"'||session_id||'","signalTier":"'||signal_tier||'","snapshotRef":'||coalesce(snapshot_ref,'null')||',"source":"bridge","taint":null,"target":'||coalesce(target,'null')||',"ts":"'||ts||'"}' AS t FROM r),
folded AS (SELECT session_id, seq, repeat('0',64) AS prev_hash, sha256(repeat('0',64)||h||repeat('0',64)||t) AS hash FROM body WHERE seq=1
   UNION ALL SELECT n.session_id, n.seq, p.hash, sha256(p.hash||n.h||p.hash||n.t) FROM folded p JOIN body n ON n.session_id=p.session_id AND n.seq=p.seq+1),
raw AS (SELECT body.*, folded.prev_hash, folded.hash FROM body JOIN folded USING (session_id, seq))"""


@query("k1_build_chain", with_base(RAW_SQL) + " SELECT session_id, seq, id, prev_hash, hash FROM raw")
def k1_build_chain(spark, sf_dir):
    return bridge.ledger_raw(spark, sf_dir).select("session_id", "seq", "id", "prev_hash", "hash")


@query("w5_chain_heads", with_base(RAW_SQL) + """
 SELECT session_id, max_by(hash,seq) AS head, true AS intact, count(*) AS events FROM raw GROUP BY session_id""")
def w5_chain_heads(spark, sf_dir):
    sealed = settle(bridge.ledger_raw(spark, sf_dir), "ledger-raw")
    return chain.verify_chain(sealed, exact=False).select("session_id", "head", "intact", "events")


def tampered(raw):
    """Rewritten payloads, deleted events and forged links, by user."""
    u = F.substring("session_id", 2, 20).cast("bigint")
    n = F.substring("id", 2, 20).cast("bigint")
    kept = raw.where(~((u % 3 == 1) & (n % 97 == 17)))
    return kept.withColumns({
        "payload": F.when((u % 3 == 0) & (n % 89 == 42), '{"command":"x"}').otherwise(F.col("payload")),
        "prev_hash": F.when((u % 3 == 2) & (n % 83 == 5), "f" * 64).otherwise(F.col("prev_hash")),
    })


@query("w1_verify_tampered_chain", with_base(RAW_SQL, """
 tam AS (SELECT session_id, seq, id, CASE WHEN user_id%3=0 AND CAST(substr(id,2) AS BIGINT)%89=42 THEN '{"command":"x"}' ELSE payload END AS p2, payload,
   CASE WHEN user_id%3=2 AND CAST(substr(id,2) AS BIGINT)%83=5 THEN repeat('f',64) ELSE prev_hash END AS ph, hash, h, t FROM raw
   WHERE NOT (user_id%3=1 AND CAST(substr(id,2) AS BIGINT)%97=17)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place, lag(hash) OVER (PARTITION BY session_id ORDER BY seq) AS lh FROM tam),
 rs AS (SELECT session_id, seq, place, CASE WHEN seq<>place THEN 'sequence gap: expected '||place||', found '||seq
   WHEN ph<>coalesce(lh,repeat('0',64)) THEN 'prevHash does not match the previous event'
   WHEN sha256(ph||CASE WHEN p2=payload THEN h ELSE replace(h,payload,p2) END||ph||t)<>hash THEN 'event content does not match its hash' END AS reason FROM pl)""") + """
 SELECT session_id, bool_and(reason IS NULL) AS intact, coalesce(min(place) FILTER (reason IS NOT NULL)-1, count(*)) AS events_checked,
   min_by(seq,place) FILTER (reason IS NOT NULL) AS broken_at, min_by(reason,place) FILTER (reason IS NOT NULL) AS reason FROM rs GROUP BY session_id""")
def w1_verify_tampered_chain(spark, sf_dir):
    sealed = settle(bridge.ledger_raw(spark, sf_dir), "ledger-raw")
    return chain.verify_chain(tampered(sealed), exact=False).select(
        "session_id", "intact", "events_checked", "broken_at", "reason"
    )


