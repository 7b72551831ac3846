"""Queries over a collection of records: repository identity and the named reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.addresses import address_kind
from ledgerlens.operators import cleaning, facts, links
from ledgerlens.operators.identity import evidence_from, find_group
from ledgerlens.plans import bridge, graph_queries as gq
from ledgerlens.plans.oracle import RF, with_base
from ledgerlens.plans.queries_ledger import SESSIONS_SQL, ledger
from ledgerlens.plans.register import query
from ledgerlens.schemas import EVIDENCE
from ledgerlens.settings import FACT_CATALOG, settle

# The facts that the bridged records carry.
CARRIED = ("RF-02", "RF-05", "RF-06", "RF-07")
GENERATORS = (
    ("", "ledgerlens", "1.0.0", FACT_CATALOG, None),
    ("x", "aider-emit", "0.3", ("RF-01", "RF-02"), 6),
    ("y", "nova-emit", "1.0", ("RF-01",), 9),
)


def bridged_records(spark, sf_dir, e, found):
    """One record per session, and re-analyses by other generators for some."""
    u = F.col("number")
    catalogs = F.array(*[
        F.struct(
            F.lit(prefix).alias("prefix"), F.lit(name).alias("generator_name"),
            F.lit(version).alias("generator_version"),
            F.array(*[F.lit(c) for c in catalog]).alias("catalog"), F.lit(every or 1).alias("every"),
        ) for prefix, name, version, catalog, every in GENERATORS
    ])
    sessions = bridge.ledger_sessions(spark, sf_dir)
    rows = sessions.select("*", F.explode(catalogs).alias("g")).where(u % F.col("g.every") == 0)
    counts = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))
    n = (u % 12).cast("string")
    digest = lambda prefix: F.sha2(F.concat(prefix, "id").cast("binary"), 256)
    urls = F.array_compact(F.array(
        F.when(bridge.origin_of(u).isNotNull(), F.struct(F.lit("origin").alias("name"), bridge.origin_of(u).alias("url"))),
        F.when(u % 13 == 0, F.struct(
            F.lit("upstream").alias("name"),
            F.concat(F.lit("https://github.com/acme/r"), ((u + 1) % 12).cast("string")).alias("url"))),
    ))
    root = lambda k: F.concat(F.lit("root"), (k % 9).cast("string"))
    frames = rows.select(
        digest(F.col("g.prefix")).alias("record_id"), F.col("id").alias("session_id"),
        digest(F.lit("h")).alias("chain_head"), "runtime_id", bridge.machine_of(u).alias("machine_id"),
        F.concat(F.lit("/w/r"), n).alias("cwd"), "started_at", "ended_at", "g.generator_name",
        "g.generator_version", F.when(u % 4 == 0, "DEGRADED").otherwise("VERIFIED").alias("integrity_status"),
        "g.catalog", urls.alias("git_remotes"),
        F.when(u % 7 == 0, F.array().cast("array<string>"))
        .when(u % 11 == 0, F.array(root(u), root(u + 1))).otherwise(F.array(root(u))).alias("git_root_commits"),
    ).join(counts, "session_id")
    frames = settle(frames, "bridged-records")
    of_record = frames.select("record_id", "session_id", "catalog").join(found, "session_id").where(
        F.array_contains("catalog", F.col("fact_id"))
    ).select(
        "record_id", F.col("ord").cast("int").alias("ord"), "fact_id", "statement", "ts", "evidence"
    )
    n_facts = of_record.groupBy("record_id").agg(F.count(F.lit(1)).alias("fact_count"))
    records = frames.drop("git_remotes", "git_root_commits").join(n_facts, "record_id", "left").withColumn(
        "fact_count", F.coalesce("fact_count", F.lit(0).cast("bigint"))
    )
    return records, evidence_from(frames), of_record


def bridged_links(spark, sf_dir):
    made = links.make_links(bridge.claims(spark, sf_dir))
    taken_back = links.make_links(bridge.retractions(made))
    return made.unionByName(taken_back).drop("doc")


NO_FACTS = f"ord int, fact_id string, statement string, ts string, evidence {EVIDENCE}"


def graph(spark, sf_dir, with_facts=False, with_files=False):
    """The bridged collection; facts and file events only for the reports that read them."""
    e = ledger(spark, sf_dir) if with_facts or with_files else bridge.ledger_events(spark, sf_dir)
    if with_facts:
        carried = {k: facts.FACTS[k] for k in CARRIED}
        found = facts.with_ordinal(settle(facts.evaluate(e, carried), "facts"))
    else:
        found = spark.createDataFrame([], NO_FACTS).withColumn("session_id", F.lit(""))
    records, evidence, of_record = bridged_records(spark, sf_dir, e, found)
    file_events = None
    if with_files:
        changed = facts.ground_truth(e).where(F.col("kind").isin("file.write", "file.delete"))
        root = F.concat(F.lit("/w/r"), (F.col("user_id") % 12).cast("string"))
        touched = cleaning.relate_paths(changed, root).select(
            "session_id", "seq", "ts", "occurred_ts", "occurred_source", "kind", "rel_path",
            F.col("path").alias("abs_path"), "in_scope",
            F.lit(None).cast("bigint").alias("bytes_before"),
            F.lit(None).cast("bigint").alias("bytes_after"),
            F.lit(None).cast("string").alias("content_withheld"),
        )
        file_events = touched.join(records.select("record_id", "session_id"), "session_id").drop("session_id")
    unreadable = records.agg(F.lit(0).cast("bigint").alias("unreadable"))
    return gq.open_graph(
        settle(records, "graph-records"), evidence, file_events,
        settle(of_record, "graph-facts") if with_facts else None,
        settle(bridged_links(spark, sf_dir), "graph-links"), unreadable,
    )


LINK_DOC = """'{"author":"'||author||'","format":"ledgerlens-link","formatVersion":1,"from":"'||fr||'","reason":"'||reason||'","to":"'||t||'","ts":"'||ts||'","type":"'||type||'"}'"""
LINKS_SQL = f"""
cl AS (SELECT 'user'||number AS author, started_at AS ts, number,
   CASE number%10 WHEN 3 THEN 'identity:same-repo' WHEN 4 THEN 'identity:distinct-repos' WHEN 5 THEN 'relates-to' ELSE 'mission' END AS type,
   CASE WHEN number%10<5 THEN 'evidence:repo/github.com/acme/r'||(number%12) ELSE 'evidence:record/'||sha256(id) END AS fr,
   CASE number%10 WHEN 3 THEN 'evidence:repo/github.com/acme/r'||((number+1)%12) WHEN 4 THEN 'evidence:repo/github.com/acme/r'||((number+4)%12)
     WHEN 5 THEN 'evidence:record/'||sha256('u'||(number+700)) ELSE 'https://tracker.example/'||number END AS t, '' AS reason FROM s WHERE number%10 IN (3,4,5,6)),
lk1 AS (SELECT *, sha256({LINK_DOC}) AS link_id FROM cl),
rt AS (SELECT author, ts, number, 'retracts' AS type, 'evidence:link/'||link_id AS fr, 'evidence:link/'||link_id AS t, 'mistaken' AS reason FROM lk1 WHERE type='identity:same-repo' AND number%5=3 AND number%3=0),
lk AS (SELECT * FROM lk1 UNION ALL SELECT *, sha256({LINK_DOC}) FROM rt),
gone AS (SELECT DISTINCT substr(t,15) AS link_id FROM lk WHERE type='retracts'),
dirs AS (SELECT CASE type WHEN 'identity:same-repo' THEN 'merge' ELSE 'distinct' END AS kind, least(substr(fr,15),substr(t,15)) AS a, greatest(substr(fr,15),substr(t,15)) AS b, link_id, author
   FROM lk ANTI JOIN gone USING (link_id) WHERE type LIKE 'identity:%')"""

RECORDS_SQL = """
ff AS (""" + " UNION ALL ".join(f"(SELECT * FROM ({RF[k]}))" for k in CARRIED) + """),
fo AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, fact_id, tie) - 1 AS ord FROM ff),
gens AS (SELECT * FROM (VALUES ('','ledgerlens','1.0.0',['RF-01','RF-02','RF-03','RF-04','RF-05','RF-06','RF-07'],1),('x','aider-emit','0.3',['RF-01','RF-02'],6),('y','nova-emit','1.0',['RF-01'],9)) g(prefix,generator_name,generator_version,catalog,every)),
rc0 AS (SELECT sha256(prefix||id) AS record_id, id AS session_id, number AS u, sha256('h'||id) AS chain_head, runtime_id, 'm'||(number%20) AS machine_id, cwd, started_at, ended_at, generator_name, generator_version,
   CASE WHEN number%4=0 THEN 'DEGRADED' ELSE 'VERIFIED' END AS integrity_status, catalog,
   CASE WHEN number%5=0 THEN NULL ELSE CASE WHEN number%4=3 THEN 'github.com:8443' ELSE 'github.com' END||'/acme/r'||(number%12) END AS origin,
   CASE WHEN number%13=0 THEN 'github.com/acme/r'||((number+1)%12) END AS upstream,
   CASE WHEN number%7=0 THEN [] WHEN number%11=0 THEN list_sort(['root'||(number%9),'root'||((number+1)%9)]) ELSE ['root'||(number%9)] END AS roots
   FROM s, gens WHERE number%every=0),
rf AS (SELECT record_id, fo.* FROM rc0 JOIN fo USING (session_id) WHERE list_contains(catalog, fact_id)),
rec AS (SELECT rc0.*, list_distinct(list_filter([origin,upstream], lambda q: q IS NOT NULL)) AS remotes, coalesce(fc,0) AS fact_count, ec AS event_count, substr(sha256(machine_id||chr(0)||cwd),1,16) AS path_key
   FROM rc0 LEFT JOIN (SELECT record_id, count(*) fc FROM rf GROUP BY 1) USING (record_id) JOIN (SELECT session_id, count(*) ec FROM b GROUP BY 1) USING (session_id)),
prim AS (SELECT session_id, chain_head, count(*)-1 AS reanalyses, arg_max(record_id, generator_name||' '||generator_version||record_id) AS record_id FROM rec GROUP BY ALL)"""

IDENTITY_SQL = """
olab AS (SELECT origin, min(record_id) AS lab FROM rec WHERE origin IS NOT NULL GROUP BY 1),
rootless AS (SELECT record_id, roots FROM rec WHERE origin IS NULL AND len(roots)>0),
redge AS (SELECT DISTINCT x.root AS p, y.root AS q FROM (SELECT record_id, unnest(roots) root FROM rootless) x JOIN (SELECT record_id, unnest(roots) root FROM rootless) y USING (record_id)),
rreach(p,q) AS (SELECT p,q FROM redge UNION SELECT r.p, e2.q FROM rreach r JOIN redge e2 ON e2.p=r.q),
comp AS (SELECT p AS root, min(q) AS component FROM rreach GROUP BY p),
adj AS (SELECT component, min(lab) lo, max(lab) hi FROM comp JOIN (SELECT unnest(roots) AS root, origin FROM rec WHERE origin IS NOT NULL) USING (root) JOIN olab USING (origin) GROUP BY 1),
lab0 AS (SELECT r.record_id, CASE WHEN r.origin IS NOT NULL THEN o.lab WHEN len(r.roots)>0 THEN CASE WHEN a.lo=a.hi THEN a.lo ELSE 'component:'||c.component END
     WHEN len(r.remotes)=0 THEN 'path:'||min(r.record_id) OVER (PARTITION BY r.path_key, r.origin IS NULL AND len(r.roots)=0 AND len(r.remotes)=0) ELSE r.record_id END AS lab,
     r.origin IS NULL AND len(r.roots)>0 AND coalesce(a.lo<>a.hi,false) AS ambiguous
   FROM rec r LEFT JOIN olab o USING (origin) LEFT JOIN comp c ON c.root=list_min(r.roots) LEFT JOIN adj a USING (component)),
sig AS (SELECT signal, min(record_id) AS record_id FROM (SELECT origin AS signal, record_id FROM rec UNION ALL SELECT unnest(remotes), record_id FROM rec UNION ALL SELECT unnest(roots), record_id FROM rec) WHERE signal IS NOT NULL GROUP BY 1),
dl AS (SELECT d.*, la.lab AS la, lb.lab AS lb, sa.record_id AS ra, sb.record_id AS rb, row_number() OVER (ORDER BY kind, a, b, link_id) AS rk
   FROM dirs d LEFT JOIN sig sa ON sa.signal=d.a LEFT JOIN lab0 la ON la.record_id=sa.record_id LEFT JOIN sig sb ON sb.signal=d.b LEFT JOIN lab0 lb ON lb.record_id=sb.record_id),
me AS (SELECT * FROM dl WHERE kind='merge' AND la IS NOT NULL AND lb IS NOT NULL),
mu AS (SELECT la AS p, lb AS q, rk FROM me UNION ALL SELECT lb, la, rk FROM me),
mreach(rk, node) AS (SELECT rk, la FROM me UNION SELECT m.rk, mu.q FROM mreach m JOIN mu ON mu.p=m.node AND mu.rk<m.rk),
outc AS (SELECT dl.*, CASE WHEN la IS NULL OR lb IS NULL THEN 'unresolvable' WHEN EXISTS (SELECT 1 FROM mreach m WHERE m.rk=dl.rk AND m.node=dl.lb) THEN 'redundant' ELSE 'applied' END AS outcome FROM dl WHERE kind='merge'),
areach(p,q) AS (SELECT lab, lab FROM lab0 UNION SELECT r.p, mu.q FROM areach r JOIN mu ON mu.p=r.q),
fin AS (SELECT record_id, g AS lab, ambiguous FROM lab0 JOIN (SELECT p AS lab, min(q) AS g FROM areach GROUP BY 1) USING (lab)),
mem AS (SELECT rec.*, fin.lab, fin.ambiguous FROM rec JOIN fin USING (record_id)),
decl AS (SELECT DISTINCT lab FROM fin WHERE record_id IN (SELECT ra FROM outc WHERE outcome='applied' UNION SELECT rb FROM outc WHERE outcome='applied')),
ged AS (SELECT DISTINCT x.lab, x.root AS p, y.root AS q FROM (SELECT lab, record_id, unnest(roots) root FROM mem) x JOIN (SELECT lab, record_id, unnest(roots) root FROM mem) y USING (lab, record_id)),
greach(lab,p,q) AS (SELECT lab,p,q FROM ged UNION SELECT g.lab, g.p, e2.q FROM greach g JOIN ged e2 ON e2.lab=g.lab AND e2.p=g.q),
gcon AS (SELECT lab, count(DISTINCT c)>1 AS conflict FROM (SELECT lab, p, min(q) c FROM greach GROUP BY ALL) GROUP BY 1),
gsig AS (SELECT lab, list_sort(list_distinct(flatten(list(remotes)))) AS remotes, list_sort(list_distinct(flatten(list(roots)))) AS roots FROM mem GROUP BY 1),
grp0 AS (SELECT lab, count(*) AS records, count(DISTINCT session_id||chain_head) AS session_count, list_sort(list_distinct(list(origin) FILTER (origin IS NOT NULL))) AS origins,
   list_sort(list_distinct(list(machine_id))) AS machines, list_sort(list_distinct(list(runtime_id))) AS runtimes, min_by(path_key, record_id) AS first_key, min_by(ambiguous, record_id) AS first_amb,
   min(started_at) AS first_started_at, max(started_at) AS last_started_at FROM mem GROUP BY 1),
grp AS (SELECT *, CASE WHEN len(coalesce(origins,[]))>0 THEN 'origin' WHEN len(roots)>0 THEN 'root' ELSE 'path' END AS basis,
   CASE WHEN len(coalesce(origins,[]))>0 THEN origins[1] WHEN len(roots)>0 THEN 'root:'||roots[1][1:12] ELSE 'path:'||first_key END AS display_name,
   coalesce(conflict,false) AS root_conflict, decl.lab IS NOT NULL AS declared
   FROM grp0 JOIN gsig USING (lab) LEFT JOIN gcon USING (lab) LEFT JOIN decl ON decl.lab=grp0.lab),
hold0 AS (SELECT 'lineage' AS kind, 'root '||unnest(roots) AS via, lab, display_name FROM grp WHERE basis='origin'
   UNION ALL SELECT 'shared-remote', 'remote '||unnest(list_distinct(list_concat(remotes, coalesce(origins,[])))), lab, display_name FROM grp),
hold AS (SELECT * FROM hold0 WHERE (kind,via) IN (SELECT (kind,via) FROM hold0 GROUP BY kind, via HAVING count(*)>1)),
pairs AS (SELECT x.kind, least(x.display_name,y.display_name) AS name_a, greatest(x.display_name,y.display_name) AS name_b, x.via FROM hold x JOIN hold y ON x.kind=y.kind AND x.via=y.via AND x.lab<y.lab),
dd AS (SELECT dl.*, ga.display_name AS na, gb.display_name AS nb FROM dl LEFT JOIN fin fa ON fa.record_id=dl.ra LEFT JOIN grp ga ON ga.lab=fa.lab LEFT JOIN fin fb ON fb.record_id=dl.rb LEFT JOIN grp gb ON gb.lab=fb.lab WHERE kind='distinct'),
dturn AS (SELECT *, least(na,nb) AS name_a, greatest(na,nb) AS name_b, row_number() OVER (PARTITION BY least(na,nb), greatest(na,nb) ORDER BY a,b,link_id) AS turn FROM dd WHERE na IS NOT NULL AND nb IS NOT NULL AND na<>nb),
pturn AS (SELECT *, row_number() OVER (PARTITION BY name_a,name_b ORDER BY kind, via) AS turn FROM pairs)"""

G = with_base(SESSIONS_SQL, LINKS_SQL, RECORDS_SQL, IDENTITY_SQL)
R_ = with_base(SESSIONS_SQL, LINKS_SQL, RECORDS_SQL)
NAMED = "(SELECT mem.*, grp.display_name AS repo FROM mem JOIN grp USING (lab))"


def joined(c):
    return F.array_join(c, ",").alias(c)


@query("a5_primaries", R_ + " SELECT session_id, record_id, reanalyses FROM prim")
def a5_primaries(spark, sf_dir):
    e = ledger(spark, sf_dir)
    found = facts.with_ordinal(settle(facts.evaluate(e, {"RF-06": facts.rf06}), "facts"))
    records, _, _ = bridged_records(spark, sf_dir, e, found)
    return gq.elect_primaries(records).select("session_id", "record_id", "reanalyses")


@query("g1_g7_groups", G + """ SELECT display_name, basis, records, session_count, array_to_string(coalesce(origins,[]),',') AS origins, array_to_string(remotes,',') AS remotes, array_to_string(roots,',') AS roots,
   array_to_string(machines,',') AS machines, array_to_string(runtimes,',') AS runtimes, first_amb AND basis<>'origin' AS ambiguous, root_conflict, declared FROM grp""")
def g1_g7_groups(spark, sf_dir):
    """Repositories after every rule and claim."""
    return graph(spark, sf_dir).resolution.groups.select(
        "display_name", "basis", "records", "session_count", joined("origins"), joined("remotes"),
        joined("roots"), joined("machines"), joined("runtimes"), "ambiguous", "root_conflict", "declared",
    )


@query("j4_record_repos", G + f" SELECT record_id, repo FROM {NAMED}")
def j4_record_repos(spark, sf_dir):
    return graph(spark, sf_dir).resolution.members.select("record_id", F.col("display_name").alias("repo"))


@query("g5_g9_directives", G + """
 SELECT link_id, outcome FROM outc
 UNION ALL SELECT link_id, CASE WHEN na IS NULL OR nb IS NULL THEN 'unresolvable' ELSE 'unenforceable' END FROM dd WHERE na IS NULL OR nb IS NULL OR na=nb
 UNION ALL SELECT d.link_id, CASE WHEN p.via IS NULL THEN 'unresolvable' ELSE 'declared' END FROM dturn d LEFT JOIN pturn p USING (name_a,name_b,turn)""")
def g5_g9_directives(spark, sf_dir):
    """What became of every identity claim."""
    g = graph(spark, sf_dir)
    r = g.resolution
    settled = r.applied.select("link_id", F.lit("applied").alias("outcome")).unionByName(
        r.unresolved.select("link_id", F.col("reason").alias("outcome"))
    )
    rest = links.derive_directives(g.links).join(settled, "link_id", "left_anti")
    return settled.unionByName(rest.select("link_id", F.lit("declared").alias("outcome")))


@query("g8_candidate_holders", G + " SELECT kind, via, display_name FROM hold")
def g8_candidate_holders(spark, sf_dir):
    return graph(spark, sf_dir).resolution.holders.select("kind", "via", "display_name")


@query("j14_candidates_of_repo", G + """ SELECT p.kind, p.name_a, p.name_b, p.via, CASE WHEN d.link_id IS NOT NULL THEN 'distinct' END AS declared, d.author AS declared_by
 FROM pturn p LEFT JOIN dturn d USING (name_a,name_b,turn) WHERE 'github.com/acme/r4' IN (p.name_a, p.name_b)""")
def j14_candidates_of_repo(spark, sf_dir):
    """G8, G9 for one repository."""
    return gq.candidates(graph(spark, sf_dir), "https://github.com/acme/r4").select(
        "kind", "name_a", "name_b", "via", "declared", "declared_by"
    )


@query("j12_find_group", G + " SELECT display_name, basis FROM grp WHERE list_contains(origins,'github.com/acme/r8')")
def j12_find_group(spark, sf_dir):
    return find_group(graph(spark, sf_dir).resolution.groups, "git@github.com:acme/r8.git").select("display_name", "basis")


@query("q1_repos", G + """ SELECT display_name, basis, session_count AS sessions, records, first_started_at, last_started_at FROM grp""")
def q1_repos(spark, sf_dir):
    return gq.repos(graph(spark, sf_dir))["groups"].select(
        "display_name", "basis", "sessions", "records", "first_started_at", "last_started_at"
    )


@query("q1_coverage", G + """ SELECT (SELECT count(*) FROM rec) AS records, (SELECT count(DISTINCT session_id||chain_head) FROM rec) AS sessions, (SELECT count(*) FROM grp) AS groups""")
def q1_coverage(spark, sf_dir):
    """What the list of repositories is based on, and how many there are."""
    return gq.repos(graph(spark, sf_dir))["coverage"].select("records", "sessions", "groups")


REPO = "github.com/acme/r1"
IN_REPO = f"(SELECT lab FROM grp WHERE display_name='{REPO}' OR list_contains(origins,'{REPO}'))"


@query("q2_repo_history", G + f""" SELECT started_at, ended_at, runtime_id AS agent, machine_id AS machine, generator_name||' '||generator_version AS generator, integrity_status, event_count AS events, fact_count AS facts,
   reanalyses, 'evidence:record/'||record_id AS cite FROM mem JOIN (SELECT record_id, reanalyses FROM prim) USING (record_id) WHERE lab IN {IN_REPO}""")
def q2_repo_history(spark, sf_dir):
    return gq.repo_history(graph(spark, sf_dir, with_facts=True), REPO)["sessions"]


FILES = """SELECT rec.record_id, seq, kind, CASE WHEN mtime_ms IS NOT NULL THEN strftime(make_timestamp(mtime_ms*1000),'%Y-%m-%dT%H:%M:%S.%gZ') ELSE ts END AS occurred_at,
   CASE WHEN mtime_ms IS NOT NULL THEN 'mtime' ELSE 'event' END AS occurred_source, CASE WHEN in_scope THEN substr(path, length(gt_cwd)+2) END AS rel_path, in_scope
   FROM (SELECT gt.*, '/w/r'||(user_id%12) AS gt_cwd FROM gt) g JOIN rec USING (session_id) WHERE kind IN ('file.write','file.delete')"""


@query("q3_file_history", G + f""" SELECT occurred_at, occurred_source, f.kind, runtime_id AS agent, machine_id AS machine, started_at AS session_started_at, 'evidence:record/'||record_id||'#'||seq AS cite
  FROM ({FILES}) f JOIN mem USING (record_id) SEMI JOIN prim USING (record_id) WHERE lab IN {IN_REPO} AND rel_path='src/f2.py'""")
def q3_file_history(spark, sf_dir):
    return gq.file_history(graph(spark, sf_dir, with_files=True), REPO, ".\\src\\f2.py")["changes"].select(
        "occurred_at", "occurred_source", "kind", "agent", "machine", "session_started_at", "cite"
    )


@query("q4_divergences", G + f""" SELECT f.ts, f.fact_id, statement, repo, runtime_id AS agent, machine_id AS machine, generator_name||' '||generator_version AS generator,
   (SELECT string_agg('evidence:record/'||f.record_id||'#'||b.seq, ',') FROM b WHERE b.id=f.cited) AS citations
  FROM rf f JOIN {NAMED} n USING (record_id) SEMI JOIN prim USING (record_id)""")
def q4_divergences(spark, sf_dir):
    return gq.divergences(graph(spark, sf_dir, with_facts=True))["divergences"].select(
        "ts", "fact_id", "statement", "repo", "agent", "machine", "generator", joined("citations")
    )


@query("q4_not_evaluated", G + " SELECT 'RF-07' AS fact_id, count(*) FILTER (NOT list_contains(catalog,'RF-07')) AS sessions FROM rec SEMI JOIN prim USING (record_id)")
def q4_not_evaluated(spark, sf_dir):
    """Sessions whose generator never looks for the fact."""
    return gq.divergences(graph(spark, sf_dir, with_facts=True), rf="RF-07")["not_evaluated"].select("fact_id", "sessions")


@query("a6_catalogs", G + """ SELECT generator_name||' '||generator_version AS generator, array_to_string(min_by(catalog,record_id),',') AS catalog FROM rec SEMI JOIN prim USING (record_id) GROUP BY 1""")
def a6_catalogs(spark, sf_dir):
    return gq.divergences(graph(spark, sf_dir, with_facts=True))["catalogs"].select("generator", joined("catalog"))


@query("q5_timeline", G + f""" SELECT started_at, ended_at, repo, runtime_id AS agent, machine_id AS machine, integrity_status, event_count AS events, fact_count AS facts, coalesce(ids,'') AS fact_ids, reanalyses
  FROM {NAMED} n JOIN (SELECT record_id, reanalyses FROM prim) USING (record_id) LEFT JOIN (SELECT record_id, string_agg(fact_id, ',' ORDER BY ord) AS ids FROM rf GROUP BY 1) USING (record_id)
  WHERE runtime_id='codex' AND started_at>='2024-01-01T01:00' AND started_at<='2024-01-03'""")
def q5_timeline(spark, sf_dir):
    rows = gq.timeline(graph(spark, sf_dir, with_facts=True), agent="codex", since="2024-01-01T01:00", until="2024-01-03")
    return rows["sessions"].select(
        "started_at", "ended_at", "repo", "agent", "machine", "integrity_status", "events", "facts",
        joined("fact_ids"), "reanalyses",
    )


_SEEN = "min(started_at) AS first_seen, max(started_at) AS last_seen, count(DISTINCT session_id||chain_head) AS sessions, count(*) AS records"


@query("q6_coverage", G + f""" SELECT 'machine' AS scope, machine_id AS name, {_SEEN} FROM rec GROUP BY 2 UNION ALL SELECT 'agent', runtime_id, {_SEEN} FROM rec GROUP BY 2
  UNION ALL SELECT 'repo', display_name, first_started_at, last_started_at, session_count, records FROM grp""")
def q6_coverage(spark, sf_dir):
    """A3 by machine, agent and repository."""
    g = graph(spark, sf_dir)
    parts = gq.coverage(g)
    row = lambda df, scope, name: df.select(
        F.lit(scope).alias("scope"), F.col(name).alias("name"), "first_seen", "last_seen", "sessions", "records"
    )
    return row(parts["machines"], "machine", "machine").unionByName(
        row(parts["agents"], "agent", "agent")
    ).unionByName(row(parts["repos"], "repo", "display_name"))


@query("q6_degraded_sessions", R_ + " SELECT count(DISTINCT session_id||chain_head) AS degraded_sessions FROM rec SEMI JOIN prim USING (record_id) WHERE integrity_status='DEGRADED'")
def q6_degraded_sessions(spark, sf_dir):
    return gq.coverage(graph(spark, sf_dir))["degraded_sessions"]


@query("a2_coverage_block", R_ + """ SELECT count(*) AS records, count(DISTINCT session_id||chain_head) AS sessions, array_to_string(list_sort(list_distinct(list(machine_id))),',') AS machines,
   array_to_string(list_sort(list_distinct(list(runtime_id))),',') AS agents, min(started_at) AS earliest, max(started_at) AS latest, 0::BIGINT AS unreadable_objects FROM rec""")
def a2_coverage_block(spark, sf_dir):
    g = graph(spark, sf_dir)
    return gq.coverage_block(g, g.records).select(
        "records", "sessions", joined("machines"), joined("agents"), "earliest", "latest", "unreadable_objects"
    )


LINK_VIEW = """ SELECT link_id, type, author, ts, fr AS "from", t AS "to", link_id IN (SELECT link_id FROM gone) AS retracted,
   (type='relates-to' AND (t NOT IN (SELECT 'evidence:record/'||record_id FROM rec) OR fr NOT IN (SELECT 'evidence:record/'||record_id FROM rec))) AS dangling FROM lk"""


@query("q7_links", R_ + LINK_VIEW)
def q7_links(spark, sf_dir):
    """Every link, whether it was taken back and whether it points at nothing."""
    return gq.links(graph(spark, sf_dir))["links"].drop("reason")


@query("q7_links_of_repo", G + LINK_VIEW + f""" WHERE EXISTS (SELECT 1 FROM grp WHERE lab IN {IN_REPO} AND (list_contains(list_concat(origins,remotes,roots,[display_name]), substr(fr,15)) OR list_contains(list_concat(origins,remotes,roots,[display_name]), substr(t,15))))
   OR fr IN (SELECT 'evidence:record/'||record_id FROM mem WHERE lab IN {IN_REPO}) OR t IN (SELECT 'evidence:record/'||record_id FROM mem WHERE lab IN {IN_REPO})""")
def q7_links_of_repo(spark, sf_dir):
    """J15."""
    return gq.links(graph(spark, sf_dir), REPO)["links"].drop("reason")


@query("g10_directives", with_base(SESSIONS_SQL, LINKS_SQL) + " SELECT kind, a, b, link_id, author FROM dirs")
def g10_directives(spark, sf_dir):
    return links.derive_directives(bridged_links(spark, sf_dir))


@query("p9_check_links", with_base(SESSIONS_SQL, LINKS_SQL) + """ SELECT link_id AS source, CASE WHEN number%7=1 THEN 'altered' WHEN number%7=2 THEN 'invalid' ELSE 'verified' END AS verdict FROM lk1""")
def p9_check_links(spark, sf_dir):
    """Links as documents, some rewritten and some without an author."""
    made = links.make_links(bridge.claims(spark, sf_dir))
    number = F.regexp_extract("author", "([0-9]+)", 1).cast("bigint")
    doc = (
        F.when(number % 7 == 1, F.replace("doc", F.lit('"reason":""'), F.lit('"reason":"x"')))
        .when(number % 7 == 2, F.regexp_replace("doc", '"author":"[^"]*"', '"author":""'))
        .otherwise(F.col("doc"))
    )
    objects = made.select(F.col("link_id").alias("source"), doc.alias("doc"))
    return links.check_links(objects).select("source", "verdict")


@query("j9_active_links", with_base(SESSIONS_SQL, LINKS_SQL) + " SELECT link_id, type FROM lk ANTI JOIN gone USING (link_id)")
def j9_active_links(spark, sf_dir):
    return links.active_links(bridged_links(spark, sf_dir)).select("link_id", "type")


@query("p14_link_endpoints", with_base(SESSIONS_SQL, LINKS_SQL) + """ SELECT link_id, CASE WHEN type LIKE 'identity%' THEN 'repo' WHEN type='retracts' THEN 'link' ELSE 'record' END AS from_kind,
  CASE WHEN type LIKE 'identity%' THEN 'repo' WHEN type='retracts' THEN 'link' WHEN type='relates-to' THEN 'record' ELSE 'external' END AS to_kind FROM lk""")
def p14_link_endpoints(spark, sf_dir):
    return bridged_links(spark, sf_dir).select(
        "link_id", address_kind(F.col("from")).alias("from_kind"), address_kind(F.col("to")).alias("to_kind")
    )
