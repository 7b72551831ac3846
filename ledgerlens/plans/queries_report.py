"""Queries for judging and reporting sessions, over the sealed raw ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import chain, diff, facts, judge, record
from ledgerlens.plans import bridge, reports
from ledgerlens.plans.oracle import CLOCK, RF, RF01_FAILED, with_base
from ledgerlens.plans.queries_ledger import RAW_SQL, SESSIONS_SQL
from ledgerlens.plans.register import query
from ledgerlens.schemas import payload_view
from ledgerlens.settings import DEFAULT_PRODUCER, settle


def sealed(spark, sf_dir):
    return settle(bridge.ledger_raw(spark, sf_dir), "ledger-raw")


def seen(spark, sf_dir, raw=None):
    """Typed events with payload fields, written once for the operators that share them."""
    raw = bridge.ledger_raw(spark, sf_dir) if raw is None else raw
    return settle(payload_view(raw).drop("_p"), "payload-view")


# The relabelled ledger as typed columns: what payload_view makes of the raw one.
VIEW_SQL = """
v AS (SELECT id, session_id, user_id, seq, ts, ts_ms, monotonic_ms, signal_tier, rkind AS kind, k,
   CASE WHEN rkind='process.exit' THEN command END AS command, CASE WHEN rkind='process.exit' THEN exit_code END AS exit_code,
   CASE WHEN rkind='process.exit' THEN signal END AS signal, CASE WHEN rkind='process.exit' THEN cwd END AS cwd,
   CASE WHEN rkind='process.exit' THEN exec_id END AS exec_id, CASE WHEN rkind='process.exit' THEN parent_exec_id END AS parent_exec_id,
   CASE WHEN rkind LIKE 'file.%' THEN path END AS path, CASE WHEN rkind LIKE 'file.%' THEN in_scope END AS in_scope,
   CASE WHEN rkind LIKE 'file.%' THEN mtime_ms END AS mtime_ms,
   CASE WHEN rkind='file.write' THEN after_ref END AS after_ref, CASE WHEN rkind='file.write' THEN before_ref END AS before_ref,
   CASE WHEN rkind='git.status' THEN dirty_count END AS dirty_count, CASE WHEN rkind='git.status' THEN dirty_known END AS dirty_known,
   CASE WHEN rkind='file.write' AND after_ref IS NULL THEN 'oversized' END AS content_withheld,
   CASE WHEN rkind='session.end' AND user_id%5<>0 THEN user_id%3 END AS end_exit,
   CASE WHEN rkind='agent.output' THEN k%3 END AS output, hash FROM raw),
gv AS (SELECT * FROM v WHERE signal_tier='groundTruth')"""

FLAGS_SQL = """
vclockp AS (SELECT session_id, seq, (ts_ms - lag(ts_ms) OVER w) - (monotonic_ms - lag(monotonic_ms) OVER w) AS drift_ms FROM gv WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
vclock AS (SELECT session_id, min(seq) AS at_seq, min_by(drift_ms, seq) AS drift_ms FROM vclockp WHERE drift_ms < -1500 GROUP BY session_id),
fl0 AS (SELECT session_id,
  count(*) FILTER (kind='process.exit') AS exits, coalesce(bool_or(kind='file.write' AND in_scope),false) AS wrote,
  count(*) FILTER (command IN ('npm test','pytest -q','npm run test:watch')) AS test_shaped,
  count(*) FILTER (command IN ('npm test','pytest -q')) AS test_runs,
  count(*) FILTER (command IN ('npm test','pytest -q') AND exit_code IS NOT NULL) AS completed_runs,
  coalesce(bool_or(kind='file.write' AND in_scope AND mtime_ms IS NULL),false) AS unknown_mtime,
  max_by(dirty_known, seq) FILTER (kind='git.status') AS dirty_known,
  bool_or(kind='session.end') AS closed,
  min_by(k, seq) FILTER (output=0) AS probe_k,
  count(*) FILTER (content_withheld IS NOT NULL) AS withheld
  FROM gv GROUP BY session_id),
ment AS (SELECT session_id, string_agg(command, ', ' ORDER BY s) FILTER (t='w') AS watch_commands, string_agg(command, ', ' ORDER BY s) FILTER (t='u') AS unfinished_commands
  FROM (SELECT session_id, command, CASE WHEN command='npm run test:watch' THEN 'w' ELSE 'u' END AS t, min(seq) AS s FROM gv
    WHERE command='npm run test:watch' OR (command IN ('npm test','pytest -q') AND exit_code IS NULL) GROUP BY ALL) GROUP BY session_id),
fl1 AS (SELECT * FROM fl0 LEFT JOIN ment USING (session_id) LEFT JOIN vclock USING (session_id))"""

LABEL = DEFAULT_PRODUCER.label
LIMITS_SQL = f"""
lim AS (
 SELECT session_id, 0 AS rank, CASE WHEN exits=0 THEN 'No commands were observed in this session, so nothing can be said about whether tests ran. Files did change. Check the coverage report — a shadowed shim records nothing, and that silence is not evidence.'
   ELSE 'No test command was recognised in this session. If tests did run, {LABEL} did not recognise the command — RF-03 and RF-04 are therefore not evidence that testing was skipped.' END AS text
   FROM fl1 WHERE (exits=0 AND wrote) OR (exits>0 AND test_shaped=0)
 UNION ALL SELECT session_id, 1, 'A watch-mode test command was observed: '||watch_commands||'. A watcher runs continuously and does not terminate with a verdict, so a test command WAS observed but no completed test run was. This is not evidence that testing was skipped, and not evidence that the tests passed.'
   FROM fl1 WHERE test_shaped>test_runs AND completed_runs=0
 UNION ALL SELECT session_id, 2, 'The wall clock moved backward during this session — event #'||at_seq||' is '||printf('%.1f',-drift_ms/1000.0)||'s earlier than the monotonic clock allows. RF-04 orders file writes against test runs by wall-derived times, so it was not evaluated; treat any timestamp-based ordering in this record as unreliable.'
   FROM fl1 WHERE at_seq IS NOT NULL
 UNION ALL SELECT session_id, 3, 'A test command was observed but produced no exit code, so it reached no verdict: '||unfinished_commands||'. {LABEL} cannot say whether the tests passed, failed, or ran at all — and this is not evidence that testing was skipped.'
   FROM fl1 WHERE test_runs>0 AND completed_runs=0
 UNION ALL SELECT session_id, 4, 'Some file writes have no modification time, so RF-04 could not determine whether they happened before or after the last test run. They are excluded, not assumed.' FROM fl1 WHERE unknown_mtime
 UNION ALL SELECT session_id, 6, 'Git working-tree state was recorded but could not be read, so RF-02 could not determine whether anything was left uncommitted. This is not a clean tree.' FROM fl1 WHERE NOT dirty_known)"""

DEGRADED_SQL = f"""
deg AS (
 SELECT session_id, 0 AS rank, 0 AS seq, 'This session has no end event. It is still running, or the wrapper died before it could close the record — anything after the last event was not observed.' AS text FROM fl1 WHERE NOT closed
 UNION ALL SELECT session_id, 1, 0, 'Shims were shadowed on PATH for: git. If the agent ran these, {LABEL} did not see it, and their absence from this report proves nothing.' FROM fl1 WHERE probe_k%2=0
 UNION ALL SELECT session_id, 2, 0, 'Coverage could not be measured for: git. This is a statement about {LABEL}, not about whether those commands ran.' FROM fl1 WHERE probe_k%2=1
 UNION ALL SELECT session_id, 3, 0, 'Command coverage was never probed for this session, so there is no measurement of which commands {LABEL} could observe.' FROM fl1 WHERE probe_k IS NULL
 UNION ALL SELECT session_id, 4, seq, 'A recorder failed during this session — fs: limit '||k||'. Its events are missing.' FROM gv WHERE output=1
 UNION ALL SELECT session_id, 5, 0, withheld||' file change(s) were recorded without content (oversized). The change is in the record; the bytes are not, so content-based facts could not be computed for them.' FROM fl1 WHERE withheld>0)"""


@query("a13_limitations", with_base(RAW_SQL, VIEW_SQL, FLAGS_SQL, LIMITS_SQL) + " SELECT session_id, rank, text FROM lim")
def a13_limitations(spark, sf_dir):
    return judge.limitations(seen(spark, sf_dir)).select("session_id", "rank", "text")


@query("a12_degradations", with_base(RAW_SQL, VIEW_SQL, FLAGS_SQL, DEGRADED_SQL) + " SELECT session_id, rank, seq, text FROM deg")
def a12_degradations(spark, sf_dir):
    return judge.degradations(seen(spark, sf_dir)).select("session_id", "rank", "seq", "text")


@query("a12_integrity", with_base(RAW_SQL, VIEW_SQL, FLAGS_SQL, DEGRADED_SQL) + """
 SELECT f.session_id, count(d.text) AS gaps, CASE WHEN count(d.text)>0 THEN 'DEGRADED' ELSE 'VERIFIED' END AS status
 FROM fl1 f LEFT JOIN deg d USING (session_id) GROUP BY f.session_id""")
def a12_integrity(spark, sf_dir):
    raw = sealed(spark, sf_dir)
    degraded = judge.degradations(seen(spark, sf_dir, raw))
    return judge.integrity(degraded, chain.verify_chain(raw, exact=False)).select("session_id", "gaps", "status")


@query("a14_recorder_notes", with_base(RAW_SQL, VIEW_SQL) + f"""
 SELECT session_id, seq, CASE output WHEN 1 THEN 'fs: limit '||k ELSE '{LABEL} refused to run ''npm'' (loop). A parent command failing because of this is not the agent''s failure.' END AS text
 FROM gv WHERE output IN (1,2)""")
def a14_recorder_notes(spark, sf_dir):
    view = seen(spark, sf_dir)
    return judge.recorder_errors(view).unionByName(judge.interference(view)).select("session_id", "seq", "text")


@query("a15_command_coverage", with_base(RAW_SQL, VIEW_SQL, FLAGS_SQL) + """
 SELECT session_id, unnest(['observed', CASE WHEN probe_k%2=0 THEN 'shadowed' ELSE 'unknown' END]) AS status, unnest(['npm','git']) AS commands FROM fl1 WHERE probe_k IS NOT NULL""")
def a15_command_coverage(spark, sf_dir):
    covered = judge.command_coverage(seen(spark, sf_dir))
    return covered.select("session_id", "status", F.array_join("commands", ",").alias("commands"))


# ---- records ------------------------------------------------------------------------

VIEW_FACTS = ",".join([
    RF01_FAILED.replace("FROM gt ", "FROM gv "), CLOCK.replace("FROM gt ", "FROM gv "),
    "vf AS (" + " UNION ALL ".join(
        f"(SELECT * FROM ({sql.replace('gt ', 'gv ').replace('FROM gt', 'FROM gv')}))" for sql in RF.values()
    ) + ")",
])
ESC = lambda c: f"replace({c},'\"','\\\"')"
RECORD_SQL = f"""
ej AS (SELECT session_id, string_agg('{{"actor":'||actor||',"hash":"'||hash||'","id":"'||id||'","kind":"'||rkind||'","monotonicTs":'||monotonic_ms||',"payload":'||payload||',"prevHash":"'||prev_hash||
   '","seq":'||seq||',"sessionId":"'||session_id||'","signalTier":"'||signal_tier||'"'||coalesce(',"snapshotRef":'||snapshot_ref,'')||',"source":"bridge"'||coalesce(',"target":'||target,'')||',"ts":"'||ts||'"}}', ',' ORDER BY seq) AS events,
   count(*) AS n, max_by(hash,seq) AS head FROM raw GROUP BY session_id),
ptr AS (SELECT vf.session_id, vf.fact_id, vf.statement, vf.ts, vf.tie, string_agg('{{"eventId":"'||e.id||'","eventSeq":'||e.seq||',"source":"'||
   CASE WHEN e.kind='process.exit' THEN 'process_exit' WHEN e.kind='git.status' THEN 'git_state' WHEN e.kind='file.delete' THEN 'file_delete' ELSE 'file_write' END||'","ts":"'||e.ts||'"}}', ',' ORDER BY list_position(string_split(vf.cited,','), e.id)) AS ev
   FROM vf JOIN v e ON e.session_id=vf.session_id AND list_contains(string_split(vf.cited,','), e.id) GROUP BY ALL),
fj AS (SELECT session_id, count(*) AS n, string_agg('{{"confidence":"high","evidence":['||ev||'],"id":"'||fact_id||'","statement":"'||{ESC('statement')}||'","ts":"'||ts||'"}}', ',' ORDER BY ts, fact_id, tie) AS facts FROM ptr GROUP BY session_id),
lj AS (SELECT session_id, string_agg('"'||{ESC('text')}||'"', ',' ORDER BY rank) AS limitations FROM lim GROUP BY session_id),
dj AS (SELECT session_id, string_agg('"'||{ESC('text')}||'"', ',' ORDER BY rank, seq) AS degraded FROM deg GROUP BY session_id),
ij AS (SELECT session_id, string_agg('"{LABEL} refused to run ''npm'' (loop). A parent command failing because of this is not the agent''s failure."', ',') AS interference FROM gv WHERE output=2 GROUP BY session_id),
rj AS (SELECT session_id, string_agg('"fs: limit '||k||'"', ',' ORDER BY seq) AS errors FROM gv WHERE output=1 GROUP BY session_id),
mach AS (SELECT session_id, '"machineId":"m'||(user_id%20)||'"' AS ident FROM gv WHERE kind='session.start'),
parts AS (SELECT s.*, ej.n AS event_count, ej.head, coalesce(fj.n,0) AS fact_count, CASE WHEN degraded IS NULL THEN 'VERIFIED' ELSE 'DEGRADED' END AS status,
   '"evidence":{{"catalog":["RF-01","RF-02","RF-03","RF-04","RF-05","RF-06","RF-07"],"closed":'||CASE WHEN closed THEN 'true' ELSE 'false' END||',"coverage":'||
   CASE WHEN probe_k IS NULL THEN '[]' ELSE '[{{"command":"npm","status":"observed"}},{{"command":"git","status":"'||CASE WHEN probe_k%2=0 THEN 'shadowed' ELSE 'unknown' END||'"}}]' END||
   ',"facts":['||coalesce(facts,'')||'],"integrity":{{"chain":{{"eventsChecked":'||ej.n||',"intact":true}},"degraded":['||coalesce(degraded,'')||'],"status":"'||CASE WHEN degraded IS NULL THEN 'VERIFIED' ELSE 'DEGRADED' END||
   '"}},"interference":['||coalesce(interference,'')||'],"limitations":['||coalesce(limitations,'')||'],"recorderErrors":['||coalesce(errors,'')||']}},"format":"{DEFAULT_PRODUCER.record_format}","formatVersion":1,"generator":{{"name":"{DEFAULT_PRODUCER.name}","version":"{DEFAULT_PRODUCER.version}"}},"identity":{{'||coalesce(ident,'')||
   '}},"observations":{{"count":'||ej.n||',"events":['||events||'],"genesis":"'||repeat('0',64)||'","head":"'||ej.head||'"}}' AS head_part,
   '"subject":{{"cwd":"'||s.cwd||'","endedAt":'||coalesce('"'||ended_at||'"','null')||',"exitCode":'||coalesce(exit_code::VARCHAR,'null')||',"mission":'||coalesce('"'||mission||'"','null')||',"runtimeId":"'||runtime_id||'","sessionId":"'||s.id||'","sessionNumber":'||number||',"startedAt":"'||started_at||'"}}' AS subject
   FROM s JOIN ej ON ej.session_id=s.id LEFT JOIN fl1 ON fl1.session_id=s.id LEFT JOIN fj ON fj.session_id=s.id LEFT JOIN lj ON lj.session_id=s.id LEFT JOIN dj ON dj.session_id=s.id
   LEFT JOIN ij ON ij.session_id=s.id LEFT JOIN rj ON rj.session_id=s.id LEFT JOIN mach ON mach.session_id=s.id),
recs AS (SELECT id AS session_id, number AS session_number, status, head AS chain_head, event_count, fact_count, ended_at,
   sha256('{{'||head_part||','||subject||'}}') AS record_id, head_part, subject FROM parts)"""
RECORDS = with_base(RAW_SQL, VIEW_SQL, FLAGS_SQL, LIMITS_SQL, DEGRADED_SQL, VIEW_FACTS, SESSIONS_SQL, RECORD_SQL)


def built_records(spark, sf_dir):
    raw = sealed(spark, sf_dir)
    sessions = bridge.ledger_sessions(spark, sf_dir).drop("first_ms", "last_ms")
    return record.build_records(raw, sessions, exact=False)


@query("a16_build_records", RECORDS + """
 SELECT session_id, session_number, status, chain_head, event_count, fact_count, record_id, sha256('{'||head_part||',"recordId":"'||record_id||'",'||subject||'}') AS doc_hash FROM recs""")
def a16_build_records(spark, sf_dir):
    """Whole records: the hash covers every byte of every document."""
    return built_records(spark, sf_dir).select(
        "session_id", "session_number", "status", "chain_head", "event_count",
        F.col("fact_count").cast("bigint").alias("fact_count"), "record_id",
        F.sha2(F.col("doc").cast("binary"), 256).alias("doc_hash"),
    )


# ---- reports ------------------------------------------------------------------------

def report_inputs(spark, sf_dir):
    raw = sealed(spark, sf_dir)
    view = settle(payload_view(raw).drop("_p"), "payload-view")
    sessions = bridge.ledger_sessions(spark, sf_dir).drop("first_ms", "last_ms")
    return raw, view, sessions


VF = with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS, SESSIONS_SQL)
SUMMARY_SQL = """
sm AS (SELECT v.*, CASE WHEN path LIKE '/w/%' THEN substr(path, length('/w/r'||(user_id%12))+2) ELSE path END AS shown FROM v),
sumv AS (SELECT *, CASE kind WHEN 'process.exit' THEN CASE WHEN signal IS NOT NULL THEN command||' was terminated by '||signal ELSE command||' exited with code '||coalesce(exit_code::VARCHAR,'unknown') END
   WHEN 'file.write' THEN 'wrote '||shown||coalesce(' (content withheld: '||content_withheld||')','') WHEN 'file.delete' THEN 'deleted '||shown WHEN 'file.read' THEN 'read '||shown
   WHEN 'git.status' THEN CASE WHEN dirty_known AND dirty_count>0 THEN 'git working tree had '||dirty_count||' uncommitted file(s)' ELSE 'git working tree was clean' END
   WHEN 'session.start' THEN 'session started' WHEN 'session.end' THEN 'session ended (exit '||coalesce(end_exit::VARCHAR,'unknown — killed by a signal')||')'
   WHEN 'agent.output' THEN 'agent output' END AS summary FROM sm),
cit AS (SELECT DISTINCT session_id, unnest(string_split(cited,',')) AS id FROM vf)"""


@query("q8_timeline", with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS, SUMMARY_SQL) + """
 SELECT session_id, seq, id, kind, signal_tier AS tier, summary, c.id IS NOT NULL AS cited FROM sumv LEFT JOIN cit c USING (session_id, id)""")
def q8_timeline(spark, sf_dir):
    """The replay of every session."""
    raw, view, sessions = report_inputs(spark, sf_dir)
    return reports.timeline(view, sessions, facts.evaluate(view)).select(
        "session_id", "seq", "id", "kind", "tier", "summary", "cited"
    )


@query("j2_cited_evidence", with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS, SUMMARY_SQL) + """
 SELECT session_id, id AS event_id, seq, kind, path AS target, summary FROM sumv SEMI JOIN cit USING (session_id, id)""")
def j2_cited_evidence(spark, sf_dir):
    raw, view, sessions = report_inputs(spark, sf_dir)
    return reports.cited_evidence(view, sessions, facts.evaluate(view)).select(
        "session_id", "event_id", "seq", "kind", "target", "summary"
    )


@query("q10_fact_steps", with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS, SUMMARY_SQL) + """
 SELECT f.session_id, f.fact_id, f.tie, 'observed' AS state, v.seq, CASE WHEN v.kind='file.write' AND mtime_ms IS NOT NULL THEN strftime(make_timestamp(mtime_ms*1000),'%Y-%m-%dT%H:%M:%S.%gZ') ELSE v.ts END AS occurred_ts, summary AS text
 FROM (SELECT *, unnest(string_split(cited,',')) AS id FROM vf) f JOIN sumv v USING (session_id, id)
 UNION ALL SELECT session_id, fact_id, tie, 'consequence', NULL, NULL, CASE fact_id WHEN 'RF-03' THEN 'Nothing was observed to verify these changes.' WHEN 'RF-04' THEN 'No test run was observed after this change.' ELSE 'The work may be half-complete.' END
 FROM vf WHERE fact_id IN ('RF-03','RF-04','RF-06')""")
def q10_fact_steps(spark, sf_dir):
    raw, view, sessions = report_inputs(spark, sf_dir)
    return reports.fact_steps(view, sessions, facts.evaluate(view)).select(
        "session_id", "fact_id", "tie", "state", "seq", "occurred_ts", "text"
    )


@query("q10_explain_catalog", VF + """
 SELECT s.id AS session_id, c.fact_id, c.title, count(vf.fact_id) AS findings FROM s CROSS JOIN (VALUES ('RF-01','Command failed'),('RF-02','Uncommitted work left behind'),('RF-03','No test command observed'),
   ('RF-04','Code changed after testing'),('RF-05','File reverted'),('RF-06','Process killed'),('RF-07','Change outside the project')) c(fact_id,title)
 LEFT JOIN vf ON vf.session_id=s.id AND vf.fact_id=c.fact_id GROUP BY ALL""")
def q10_explain_catalog(spark, sf_dir):
    raw, view, sessions = report_inputs(spark, sf_dir)
    return reports.explain_catalog(sessions, facts.evaluate(view))


@query("a8_file_changes", with_base(RAW_SQL, VIEW_SQL) + """
 SELECT session_id, path, min_by(in_scope,seq) AS in_scope, max_by(kind,seq)='file.delete' AS deleted, count(*) FILTER (kind='file.write') AS writes,
   min_by(ts,seq) AS first_ts, max_by(ts,seq) AS last_ts, split_part(path,'/',-1) AS name,
   min_by(before_ref,seq) FILTER (before_ref IS NOT NULL) AS before_ref, max_by(after_ref,seq) FILTER (after_ref IS NOT NULL) AS after_ref,
   coalesce(max_by(CASE WHEN content_withheld IS NOT NULL THEN 'oversized' ELSE 'available' END,seq) FILTER (content_withheld IS NOT NULL OR after_ref IS NOT NULL OR before_ref IS NOT NULL),'never-captured') AS content
 FROM gv WHERE kind IN ('file.write','file.delete') GROUP BY session_id, path""")
def a8_file_changes(spark, sf_dir):
    raw, view, sessions = report_inputs(spark, sf_dir)
    return reports.file_changes(view, sessions).select(
        "session_id", "path", "in_scope", "deleted", "writes", "first_ts", "last_ts", "name",
        "before_ref", "after_ref", "content",
    )


@query("j8_missing_blobs", with_base(RAW_SQL, VIEW_SQL) + """,
 ch AS (SELECT session_id, path, min_by(before_ref,seq) FILTER (before_ref IS NOT NULL) AS b, max_by(after_ref,seq) FILTER (after_ref IS NOT NULL) AS a,
   coalesce(max_by(CASE WHEN content_withheld IS NOT NULL THEN 'oversized' ELSE 'available' END,seq) FILTER (content_withheld IS NOT NULL OR after_ref IS NOT NULL OR before_ref IS NOT NULL),'never-captured') AS content
 FROM gv WHERE kind IN ('file.write','file.delete') GROUP BY session_id, path)
 SELECT session_id, path, CASE WHEN content='available' AND (coalesce(b,'b0') NOT IN ('b0','b1') OR coalesce(a,'b0') NOT IN ('b0','b1')) THEN 'blob-missing' ELSE content END AS content FROM ch""")
def j8_missing_blobs(spark, sf_dir):
    """Changes against a blob table that kept only two of the contents."""
    raw, view, sessions = report_inputs(spark, sf_dir)
    held = view.select(F.col("after_ref").alias("ref")).where(F.col("ref").isin("b0", "b1")).distinct()
    return reports.file_changes(view, sessions, held).select("session_id", "path", "content")


@query("a9_git_view", with_base(RAW_SQL, VIEW_SQL) + """
 SELECT session_id, count(*) FILTER (kind='git.commit') AS commits, 'main' AS branch,
   max_by(CASE WHEN dirty_known THEN CASE dirty_count WHEN 0 THEN '' WHEN 1 THEN 'src/a.py' ELSE 'src/a.py,src/b.py' END ELSE '?' END,seq) AS dirty
 FROM gv WHERE kind LIKE 'git.%' GROUP BY session_id""")
def a9_git_view(spark, sf_dir):
    raw, view, _ = report_inputs(spark, sf_dir)
    views, _ = reports.git_view(view)
    return views.select(
        "session_id", "commits", "branch",
        F.coalesce(F.array_join("dirty_at_end", ","), F.lit("?")).alias("dirty"),
    )


COUNTERS = """ct AS (SELECT session_id, count(*) AS events, count(*) FILTER (kind='process.exit') AS commands,
  count(DISTINCT CASE WHEN kind IN ('file.write','file.delete') THEN path END) AS files_changed FROM v GROUP BY session_id)"""


@query("a10_counters", with_base(RAW_SQL, VIEW_SQL, COUNTERS) + " SELECT session_id, events, commands, files_changed FROM ct")
def a10_counters(spark, sf_dir):
    return reports.counters(seen(spark, sf_dir)).select("session_id", "events", "commands", "files_changed")


@query("c22_outcomes", with_base(RAW_SQL, VIEW_SQL) + """
 SELECT session_id, CASE WHEN n=0 THEN 'not-closed' WHEN x IS NULL THEN 'killed' ELSE 'exited' END AS state,
  CASE WHEN n=0 THEN 'no session end was recorded — the session is still running, or the wrapper did not close it' WHEN x IS NULL THEN 'the agent was killed by a signal; no exit code exists' ELSE 'the agent exited with code '||x END AS text
 FROM (SELECT session_id, count(*) FILTER (kind='session.end') AS n, max(end_exit) AS x FROM v GROUP BY session_id)""")
def c22_outcomes(spark, sf_dir):
    return reports.outcomes(seen(spark, sf_dir)).select("session_id", "state", "text")


INDEX_SQL = with_base(RAW_SQL, VIEW_SQL, VIEW_FACTS, FLAGS_SQL, DEGRADED_SQL, SESSIONS_SQL, COUNTERS) + """,
 ix AS (SELECT s.id AS session_id, number, CASE WHEN d.gaps>0 THEN 'DEGRADED' ELSE 'VERIFIED' END AS status, coalesce(d.gaps,0) AS gaps,
   coalesce(f.n,0) AS fact_count, coalesce(closed,false) AS closed, ct.files_changed, ct.commands, ct.events
 FROM s JOIN ct ON ct.session_id=s.id LEFT JOIN fl1 ON fl1.session_id=s.id LEFT JOIN (SELECT session_id, count(*) gaps FROM deg GROUP BY 1) d ON d.session_id=s.id
 LEFT JOIN (SELECT session_id, count(*) n FROM vf GROUP BY 1) f ON f.session_id=s.id)"""


def judged(raw, view):
    degraded = judge.degradations(view)
    states = judge.integrity(degraded, chain.verify_chain(raw, exact=False)).select("session_id", "status", "gaps")
    return states.join(judge.session_flags(view).select("session_id", "closed"), "session_id", "left")


@query("q9_session_index", INDEX_SQL + """
 SELECT session_id, number, status, CASE WHEN fact_count>0 THEN 'divergences-observed' ELSE 'none-observed' END AS facts_verdict, fact_count, closed, files_changed, commands, events
 FROM ix ORDER BY number DESC LIMIT 50""")
def q9_session_index(spark, sf_dir):
    """The fifty newest sessions, judged."""
    raw, view, sessions = report_inputs(spark, sf_dir)
    return reports.session_index(sessions, view, facts.evaluate(view), judged(raw, view), limit=50).select(
        "session_id", "number", "status", "facts_verdict", "fact_count", "closed", "files_changed",
        "commands", "events",
    )


@query("c23_verdicts", INDEX_SQL + """
 SELECT session_id, CASE WHEN fact_count>0 THEN fact_count||' divergence'||CASE WHEN fact_count=1 THEN '' ELSE 's' END||' observed' ELSE 'No divergences observed' END AS finding,
   CASE WHEN fact_count>0 THEN 'warn' ELSE 'ok' END AS finding_tone,
   CASE WHEN gaps>0 THEN 'Evidence incomplete · '||gaps||' gap'||CASE WHEN gaps=1 THEN '' ELSE 's' END ELSE 'Evidence complete' END AS coverage FROM ix""")
def c23_verdicts(spark, sf_dir):
    raw, view, sessions = report_inputs(spark, sf_dir)
    states = settle(judged(raw, view), "judged")
    index = reports.session_index(sessions, view, facts.evaluate(view), states)
    return reports.session_verdicts(index, states.select("session_id", "gaps")).select(
        "session_id", "finding", "finding_tone", "coverage"
    )


@query("q13_status", with_base(RAW_SQL, VIEW_SQL, SESSIONS_SQL) + """
 SELECT s.id AS session_id, number, ended_at IS NULL AS open, (SELECT count(*) FROM v WHERE v.session_id=s.id) AS events_captured, true AS intact FROM s ORDER BY number DESC LIMIT 1""")
def q13_status(spark, sf_dir):
    raw = sealed(spark, sf_dir)
    sessions = bridge.ledger_sessions(spark, sf_dir)
    return reports.status_report(sessions, raw).select(
        "session_id", "number", "open", "events_captured", "intact"
    )


@query("q14_sessions", with_base(SESSIONS_SQL) + """
 SELECT number, coalesce(mission,'(no mission recorded)') AS label, started_at, CASE WHEN ended_at IS NOT NULL THEN last_ms-first_ms END AS duration_ms, ended_at IS NULL AS open
 FROM s ORDER BY number DESC LIMIT 50""")
def q14_sessions(spark, sf_dir):
    return reports.session_listing(bridge.ledger_sessions(spark, sf_dir), limit=50)


# ---- diffs --------------------------------------------------------------------------

def document_changes(spark, sf_dir):
    """Every document as a change from the one before it, with contents as blobs."""
    docs = bridge.load(spark, sf_dir, "documents").select("doc_id", "text")
    # Sentences as lines: the texts themselves have few line ends.
    lines = docs.select("doc_id", F.regexp_replace("text", r"\. ", ".\n").alias("text"))
    ref = F.sha2(F.col("text").cast("binary"), 256)
    blobs = lines.select(
        ref.alias("ref"), F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").cast("binary").alias("content"),
    ).dropDuplicates(["ref"])
    # Names alone are written down, not the texts a second time.
    here = settle(lines.select("doc_id", ref.alias("after_ref")), "document-refs")
    before = here.select((F.col("doc_id") + 1).alias("doc_id"), F.col("after_ref").alias("before_ref"))
    changes = here.join(before, "doc_id", "left").select(
        F.lit("docs").alias("session_id"), F.col("doc_id").cast("string").alias("path"),
        F.lit("available").alias("content"), F.lit(None).cast("string").alias("content_note"),
        "before_ref", "after_ref",
    )
    return changes, blobs


@query("j16_diff_inputs", r"""
 WITH d AS (SELECT doc_id, regexp_replace(text, '\. ', E'.\n', 'g') AS t FROM documents)
 SELECT a.doc_id::VARCHAR AS path, sha256(b.t) AS before_hash, sha256(a.t) AS after_hash FROM d a LEFT JOIN d b ON a.doc_id=b.doc_id+1""")
def j16_diff_inputs(spark, sf_dir):
    changes, blobs = document_changes(spark, sf_dir)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return diff.diff_inputs(changes, blobs).select(
        "path", digest("before").alias("before_hash"), digest("after").alias("after_hash")
    )


@query("q12_line_diff", r"""
 WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\. ', E'.\n', 'g'), E'\n') AS t FROM documents),
 p AS (SELECT a.doc_id::VARCHAR AS path, len(a.t) AS n_after, len(b.t) AS n_before, b.t=a.t AS same,
   array_to_string(b.t, chr(10)) AS before, array_to_string(a.t, chr(10)) AS after FROM d a LEFT JOIN d b ON a.doc_id=b.doc_id+1)
 SELECT path, CASE WHEN same THEN 0 ELSE coalesce(n_before,0) END::BIGINT AS before_lines, CASE WHEN same THEN 0 ELSE n_after END::BIGINT AS after_lines, CASE WHEN same THEN 1 ELSE 0 END::BIGINT AS notes,
   sha256(CASE WHEN same THEN '' ELSE coalesce(before,'') END) AS before_hash, sha256(CASE WHEN same THEN '' ELSE coalesce(after,'') END) AS after_hash
 FROM p""")
def q12_line_diff(spark, sf_dir):
    """A diff must use every line of both sides exactly once and rebuild both texts."""
    changes, blobs = document_changes(spark, sf_dir)
    return rebuilt_texts(diff.line_diff(diff.diff_inputs(changes, blobs)))


def rebuilt_texts(lines):
    """``path, before_lines, after_lines, notes, before_hash, after_hash`` of every path's lines.

    Lines that lie one after the other are counted and hashed where they are; only the lines of
    paths that come in several runs are gathered.
    """
    runs = settle(lines.select("path", "line_no", "op", F.col("text").cast("binary").alias("text")).mapInArrow(_runs, RUNS), "line-runs")
    several = settle(runs.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("path").alias("_path")), "line-several")
    if several.isEmpty():
        return runs
    own = F.col("path").eqNullSafe(F.col("_path"))
    return runs.join(several, own, "left_anti").unionByName(_gathered(lines.join(several, own, "left_semi")))


RUNS = "path string, before_lines bigint, after_lines bigint, notes bigint, before_hash string, after_hash string"


def _runs(batches):
    """One row for each run of lines of one path whose numbers count up from the first."""
    import hashlib

    import pyarrow as pa

    names = [c.split(" ")[0] for c in RUNS.split(", ")]
    sides = {" ": (0, 1), "-": (0,), "+": (1,)}
    at, last, counts, told = None, None, None, None

    def ended():
        return dict(zip(names, (at, *counts, *(t.hexdigest() for t in told))))

    for batch in batches:
        done = []
        for path, number, op, text in zip(*(batch.column(c).to_pylist() for c in ("path", "line_no", "op", "text"))):
            if counts is None or path != at or number != last + 1:
                if counts is not None:
                    done.append(ended())
                at, counts, told = path, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
            last = number
            counts[2] += op == "note"
            for side in sides.get(op, ()):
                told[side].update(b"\n" + text if counts[side] else text)
                counts[side] += 1
        if done:
            yield pa.RecordBatch.from_pylist(done)
    if counts is not None:
        yield pa.RecordBatch.from_pylist([ended()])


def _gathered(lines):
    def rebuilt(*ops):
        side = F.sort_array(F.collect_list(F.when(F.col("op").isin(*ops), F.struct("line_no", "text"))))
        return F.sha2(F.array_join(F.transform(side, lambda x: x["text"]), "\n").cast("binary"), 256)

    return lines.groupBy("path").agg(
        F.count_if(F.col("op").isin(" ", "-")).alias("before_lines"),
        F.count_if(F.col("op").isin(" ", "+")).alias("after_lines"),
        F.count_if(F.col("op") == "note").alias("notes"),
        rebuilt(" ", "-").alias("before_hash"), rebuilt(" ", "+").alias("after_hash"),
    )


@query("q12_odd_bytes", """
 WITH d AS (SELECT doc_id, replace(text, chr(10), ' ') || chr(10) || CASE WHEN doc_id%3=0 THEN 'caf' || chr(65533) ELSE 'plain' END AS t FROM documents),
 p AS (SELECT a.doc_id, a.t AS a, b.t AS b FROM d a LEFT JOIN d b ON a.doc_id=b.doc_id+1)
 SELECT doc_id::VARCHAR AS path, CASE WHEN a=b THEN 'note' WHEN b IS NULL THEN '++' WHEN string_split(a,chr(10))[1]=string_split(b,chr(10))[1] THEN ' -+'
   WHEN string_split(a,chr(10))[2]=string_split(b,chr(10))[2] THEN '-+ ' ELSE '--++' END AS ops,
   coalesce(contains(a, chr(65533)) AND a IS DISTINCT FROM b, false) AS replaced FROM p""")
def q12_odd_bytes(spark, sf_dir):
    """Every third blob ends in a byte that is no UTF-8; all changes still get their diff."""
    docs = bridge.load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n"))
    odd = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("636166E9"))).otherwise(F.lit(b"plain"))
    rows = docs.select("doc_id", F.concat(text.cast("binary"), odd).alias("content")).withColumn("ref", F.sha2("content", 256))
    blobs = rows.select("ref", F.octet_length("content").cast("bigint").alias("length"), "content").dropDuplicates(["ref"])
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("ref").alias("before_ref"))
    changes = rows.join(before, "doc_id", "left").select(
        F.lit("docs").alias("session_id"), F.col("doc_id").cast("string").alias("path"), F.lit("available").alias("content"),
        F.lit(None).cast("string").alias("content_note"), "before_ref", F.col("ref").alias("after_ref"),
    )
    lines = diff.line_diff(diff.diff_inputs(changes, blobs))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "op")))
    return lines.groupBy("path").agg(
        F.array_join(F.transform(ordered, lambda x: x["op"]), "").alias("ops"),
        F.coalesce(F.bool_or(F.contains("text", F.lit("\ufffd")) & F.col("op").isin("+", " ")), F.lit(False)).alias("replaced"),
    )
