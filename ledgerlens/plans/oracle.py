"""The bridge ledger and shared steps in plain SQL, for cross-checking in another engine."""

from __future__ import annotations

BASE = """
e AS (SELECT event_id, user_id, event_type, epoch_us(ts)//1000 AS ms, concat('e',event_id) AS id,
  CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events),
x AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ms,id) AS parent_event
  FROM e WHERE event_type IN ('click','error')),
b AS (SELECT e.id, concat('u',user_id) AS session_id, user_id, k,
  row_number() OVER (PARTITION BY user_id ORDER BY ms,id) AS seq,
  count(*) OVER (PARTITION BY user_id) AS session_rows,
  ms AS ts_ms, strftime(make_timestamp(ms*1000),'%Y-%m-%dT%H:%M:%S.%gZ') AS ts,
  ms - min(ms) OVER (PARTITION BY user_id) - (CASE WHEN k=0 THEN 5000 ELSE 0 END) AS monotonic_ms,
  CASE WHEN k%10=9 THEN 'narration' WHEN k%10=8 THEN 'intent' ELSE 'groundTruth' END AS signal_tier,
  CASE event_type WHEN 'click' THEN 'process.exit' WHEN 'error' THEN 'process.exit' WHEN 'purchase' THEN 'file.write'
    WHEN 'signup' THEN 'git.status' ELSE CASE WHEN k%4=0 THEN 'file.delete' ELSE 'file.read' END END AS kind,
  CASE WHEN event_type IN ('click','error') THEN CASE k%5 WHEN 0 THEN 'npm test' WHEN 1 THEN 'pytest -q'
    WHEN 2 THEN 'npm run build' WHEN 3 THEN 'npm run test:watch' ELSE 'git push --force' END END AS command,
  CASE WHEN event_type='click' THEN 0 WHEN event_type='error' AND k%7<>0 THEN 1 END AS exit_code,
  CASE WHEN event_type='error' AND k%7=0 THEN 'SIGKILL' END AS signal,
  concat('/w/r',user_id%12,CASE WHEN k%2=0 THEN '/a' ELSE '/b' END) AS cwd,
  CASE WHEN event_type IN ('click','error') THEN concat('x',e.event_id) END AS exec_id,
  CASE WHEN event_type IN ('click','error') AND k%3=0 THEN 'x' || CAST(parent_event AS VARCHAR) END AS parent_exec_id,
  CASE WHEN event_type IN ('purchase','view') THEN concat(CASE WHEN k%11=0 THEN '/etc' ELSE concat('/w/r',user_id%12,'/src') END,'/f',k%10,'.py') END AS path,
  k%11<>0 AS in_scope,
  CASE WHEN event_type='purchase' AND k%13<>0 THEN ms+(k-50)*60000 END AS mtime_ms,
  CASE WHEN event_type='purchase' AND k%6<>0 THEN concat('b',k%4) END AS after_ref,
  CASE WHEN event_type='purchase' AND k%5<>0 THEN concat('b',k%3) END AS before_ref,
  CASE WHEN event_type='signup' THEN k%3 END AS dirty_count,
  event_type='signup' AND k%17<>0 AS dirty_known
  FROM e LEFT JOIN x USING (event_id))"""

GT = "gt AS (SELECT * FROM b WHERE signal_tier='groundTruth')"

RF01_FAILED = r"""
xt AS (SELECT * FROM gt WHERE kind='process.exit'),
keyed AS (SELECT *, row_number() OVER (PARTITION BY session_id,cwd,command ORDER BY seq DESC) AS rr,
  min(seq) OVER (PARTITION BY session_id,cwd,command) AS first_seq FROM xt),
lastv AS (SELECT session_id,cwd,command,first_seq,
  CASE WHEN exit_code=0 THEN 'pass' WHEN exit_code IS NOT NULL THEN 'fail' ELSE 'none' END AS last_verdict
  FROM keyed WHERE rr=1),
fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id,cwd,command ORDER BY seq DESC) AS fr
  FROM xt WHERE exit_code<>0) WHERE fr=1),
f AS (SELECT fl.*, first_seq, last_verdict FROM fl JOIN lastv USING (session_id,cwd,command)),
pof AS (SELECT session_id, exec_id, parent_exec_id AS up FROM xt WHERE parent_exec_id IS NOT NULL),
walk AS (SELECT session_id, id, seq, parent_exec_id AS cur FROM f WHERE parent_exec_id IS NOT NULL
  UNION ALL SELECT w.session_id, w.id, w.seq, p.up FROM walk w JOIN pof p ON p.session_id=w.session_id AND p.exec_id=w.cur),
anc AS (SELECT DISTINCT w.session_id, w.id, w.seq, a.exec_id AS anc_exec, a.id AS anc_id FROM walk w JOIN f a ON a.session_id=w.session_id AND a.exec_id=w.cur),
rep AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM anc WHERE anc.session_id=f.session_id AND anc.id=f.id))"""

# Facts with their pointers as text: eventId joined by ',' in order.
RF = {
    "RF-01": """SELECT rep.session_id, 'RF-01' AS fact_id,
  concat(rep.command,' exited with code ',rep.exit_code,CASE WHEN rep.last_verdict='pass' THEN ', then passed on a later run' ELSE '' END) AS statement,
  rep.ts, rep.first_seq AS tie, rep.id || coalesce((SELECT string_agg(','||d.id,'' ORDER BY d.first_seq) FROM anc JOIN f d ON d.id=anc.id WHERE anc.anc_id=rep.id),'') AS cited
  FROM rep""",
    "RF-02": """SELECT session_id, 'RF-02' AS fact_id, CASE WHEN dirty_count=1 THEN '1 file was left uncommitted: src/a.py' ELSE concat(dirty_count,' files were left uncommitted') END AS statement,
  ts, seq AS tie, id AS cited FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) rn FROM gt WHERE kind='git.status') WHERE rn=1 AND dirty_known AND dirty_count>0""",
    "RF-03": """SELECT session_id, 'RF-03' AS fact_id, concat(n,' file(s) modified; no test command was observed in this session') AS statement, wts AS ts, wseq AS tie, wid||','||xid AS cited
  FROM (SELECT session_id, count(DISTINCT CASE WHEN kind='file.write' AND in_scope THEN path END) n,
    max_by(ts, seq) FILTER (kind='file.write' AND in_scope) wts, max(seq) FILTER (kind='file.write' AND in_scope) wseq,
    max_by(id, seq) FILTER (kind='file.write' AND in_scope) wid, max_by(id, seq) FILTER (kind='process.exit') xid,
    bool_or(coalesce(command IN ('npm test','pytest -q','npm run test:watch'),false)) tested
    FROM gt GROUP BY session_id) WHERE wid IS NOT NULL AND xid IS NOT NULL AND NOT tested""",
    "RF-04": """SELECT w.session_id, 'RF-04' AS fact_id, concat(split_part(w.path,'/',-1),' modified after the last test run') AS statement, w.ts, w.seq AS tie, w.id||','||w.tid AS cited
  FROM (SELECT g.*, t.tid, row_number() OVER (PARTITION BY g.session_id,g.path ORDER BY g.seq) rn FROM gt g
    JOIN (SELECT session_id, max_by(ts_ms,seq) tms, max_by(id,seq) tid FROM gt WHERE command IN ('npm test','pytest -q') AND exit_code IS NOT NULL GROUP BY 1) t USING (session_id)
    WHERE g.kind='file.write' AND g.in_scope AND g.mtime_ms>t.tms AND g.session_id NOT IN (SELECT session_id FROM clock)) w WHERE rn=1""",
    "RF-05": """SELECT w.session_id, 'RF-05' AS fact_id, concat(split_part(w.path,'/',-1),' was changed and then reverted to earlier content') AS statement, w.ts, w.seq AS tie, w.id AS cited
  FROM gt w WHERE w.kind='file.write' AND w.in_scope AND w.after_ref IS NOT NULL AND w.before_ref IS DISTINCT FROM w.after_ref
  AND EXISTS (SELECT 1 FROM gt p WHERE p.session_id=w.session_id AND p.path=w.path AND p.kind='file.write' AND p.in_scope AND p.after_ref IS NOT NULL
    AND p.seq<w.seq AND (p.after_ref=w.after_ref OR p.before_ref=w.after_ref))""",
    "RF-06": """SELECT session_id, 'RF-06' AS fact_id, concat(command,' was terminated by ',signal) AS statement, ts, seq AS tie, id AS cited FROM gt WHERE kind='process.exit' AND signal IS NOT NULL""",
    "RF-07": """SELECT session_id, 'RF-07' AS fact_id, concat(path,' was modified, outside the project directory') AS statement, ts, seq AS tie, id AS cited
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id,path ORDER BY seq) rn FROM gt WHERE kind IN ('file.write','file.delete') AND NOT in_scope) WHERE rn=1""",
}

CLOCK = """
clockp AS (SELECT session_id, seq, (ts_ms - lag(ts_ms) OVER w) - (monotonic_ms - lag(monotonic_ms) OVER w) AS drift_ms
  FROM gt WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
clock AS (SELECT session_id, min(seq) AS at_seq, min_by(drift_ms, seq) AS drift_ms FROM clockp WHERE drift_ms < -1500 GROUP BY session_id)"""


def with_base(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([BASE, GT, *ctes])


FACTS = ",".join([
    CLOCK, RF01_FAILED,
    "facts AS (" + " UNION ALL ".join(f"(SELECT * FROM ({q}))" for q in RF.values()) + ")",
])
