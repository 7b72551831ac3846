"""An evidence ledger derived from the ``events`` table.

Every row of ``events`` becomes one ledger event and every user one session, so
ledger work grows with the table.  Positions and previous values come from
:func:`ordered_view`, bucketed by minute, so one busy user is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.chain import build_chain
from ledgerlens.operators.ordered import ordered_view
from ledgerlens.schemas import iso_ms

FILE_KINDS = ("file.write", "file.delete", "file.read")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    e = e.withColumn(
        "exec_at", F.when(F.col("event_type").isin("click", "error"), F.col("event_id"))
    )
    minute = F.floor(F.col("ms") / 60000).cast("bigint")
    placed = ordered_view(
        e, ["user_id"], minute, ["ms", "id"], position="seq",
        totals={
            "first_ms": (F.min("ms"), "min"),
            "session_rows": (F.count(F.lit(1)), "sum"),
        },
    )
    execs = ordered_view(
        e.where(F.col("exec_at").isNotNull()).select("user_id", "event_id", "ms", "id"),
        ["user_id"], minute, ["ms", "id"], lags={"parent_event": "event_id"},
    ).select("event_id", "parent_event")
    return placed.join(execs, "event_id", "left")


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events (the columns of ``schemas.TYPED``) for the whole table."""
    b = base_events(spark, sf_dir)
    k, kind = F.col("k"), F.col("kind")
    is_exec = F.col("event_type").isin("click", "error")
    repo = F.concat(F.lit("/w/r"), (F.col("user_id") % 12).cast("string"))
    command = (
        F.when(k % 5 == 0, "npm test").when(k % 5 == 1, "pytest -q")
        .when(k % 5 == 2, "npm run build").when(k % 5 == 3, "npm run test:watch")
        .otherwise("git push --force")
    )
    return b.select(
        "id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        "user_id",
        "seq",
        F.col("ms").alias("ts_ms"),
        iso_ms(F.col("ms")).alias("ts"),
        (F.col("ms") - F.col("first_ms") - F.when(k == 0, 5000).otherwise(0)).alias("monotonic_ms"),
        F.when(k % 10 == 9, "narration").when(k % 10 == 8, "intent")
        .otherwise("groundTruth").alias("signal_tier"),
        F.when(is_exec, "process.exit")
        .when(F.col("event_type") == "purchase", "file.write")
        .when(F.col("event_type") == "signup", "git.status")
        .when(k % 4 == 0, "file.delete")
        .otherwise("file.read").alias("kind"),
        F.when(is_exec, command).alias("command"),
        F.when(F.col("event_type") == "click", 0)
        .when((F.col("event_type") == "error") & (k % 7 != 0), 1).alias("exit_code"),
        F.when((F.col("event_type") == "error") & (k % 7 == 0), "SIGKILL").alias("signal"),
        F.concat(repo, F.when(k % 2 == 0, "/a").otherwise("/b")).alias("cwd"),
        F.when(is_exec, F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("exec_id"),
        F.when(
            is_exec & (k % 3 == 0), F.concat(F.lit("x"), F.col("parent_event").cast("string"))
        ).alias("parent_exec_id"),
        F.when(
            F.col("event_type").isin("purchase", "view"),
            F.concat(
                F.when(k % 11 == 0, "/etc").otherwise(F.concat(repo, F.lit("/src"))),
                F.lit("/f"), (k % 10).cast("string"), F.lit(".py"),
            ),
        ).alias("path"),
        (k % 11 != 0).alias("in_scope"),
        F.when(
            (F.col("event_type") == "purchase") & (k % 13 != 0), F.col("ms") + (k - 50) * 60000
        ).alias("mtime_ms"),
        F.when(
            (F.col("event_type") == "purchase") & (k % 6 != 0),
            F.concat(F.lit("b"), (k % 4).cast("string")),
        ).alias("after_ref"),
        F.when(
            (F.col("event_type") == "purchase") & (k % 5 != 0),
            F.concat(F.lit("b"), (k % 3).cast("string")),
        ).alias("before_ref"),
        F.when(F.col("event_type") == "signup", k % 3).alias("dirty_count"),
        F.when(
            F.col("event_type") == "signup",
            F.slice(F.array(F.lit("src/a.py"), F.lit("src/b.py")), 1, F.col("k") % 3),
        ).alias("dirty"),
        ((F.col("event_type") == "signup") & (k % 17 != 0)).alias("dirty_known"),
        F.col("k"),
        "session_rows",
    )


def ledger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One framing row per session; every fourth user never closed theirs."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("first_ms"),
        F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"),
    )
    u = F.col("user_id")
    closed = u % 4 != 0
    return e.select(
        F.concat(F.lit("u"), u.cast("string")).alias("id"),
        u.alias("number"),
        runtime_of(u).alias("runtime_id"),
        F.when(u % 2 == 0, F.concat(F.lit("fix issue "), u.cast("string"))).alias("mission"),
        iso_ms(F.col("first_ms")).alias("started_at"),
        F.when(closed, iso_ms(F.col("last_ms"))).alias("ended_at"),
        F.when(closed & (u % 5 != 0), u % 3).alias("exit_code"),
        F.concat(F.lit("/w/r"), (u % 12).cast("string")).alias("cwd"),
        F.col("first_ms"),
        F.col("last_ms"),
    )


def runtime_of(u):
    return F.when(u % 3 == 0, "claude-code").when(u % 3 == 1, "codex").otherwise("aider")


def machine_of(u):
    return F.concat(F.lit("m"), (u % 20).cast("string"))


def origin_of(u):
    n = (u % 12).cast("string")
    return F.when(u % 5 == 0, F.lit(None)).otherwise(
        F.when(u % 4 == 0, F.concat(F.lit("https://GitHub.com/acme/r"), n, F.lit(".git")))
        .when(u % 4 == 1, F.concat(F.lit("git@github.com:acme/r"), n, F.lit(".git")))
        .when(u % 4 == 2, F.concat(F.lit("ssh://git@github.com:22/acme/r"), n))
        .otherwise(F.concat(F.lit("https://u:t@github.com:8443/acme/r"), n, F.lit("/")))
    )


def _quote(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def _or_null(c):
    return F.coalesce(c, F.lit("null"))


def ledger_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger as unsealed raw events with JSON payloads (schemas.DRAFT_COLUMNS).

    The first event of a session is its start, the last one its end unless the user
    never closes, and some reads become the recorder's own notes.
    """
    e = ledger_events(spark, sf_dir)
    k, u = F.col("k"), F.col("user_id")
    note = (F.col("kind") == "file.read") & (k % 8 == 1)
    kind = (
        F.when(F.col("seq") == 1, "session.start")
        .when((F.col("seq") == F.col("session_rows")) & (u % 4 != 0), "session.end")
        .when(note, "agent.output").otherwise(F.col("kind"))
    )
    e = e.withColumn("kind", kind)
    is_file = F.col("kind").isin(*FILE_KINDS)
    n = (u % 12).cast("string")
    root = F.when(u % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"root'), (u % 9).cast("string"), F.lit('"'))
    )
    url = origin_of(u)
    remotes = F.coalesce(F.concat(F.lit('{"name":"origin","url":"'), url, F.lit('"}')), F.lit(""))
    start = F.concat(
        F.lit('{"cwd":"/w/r'), n, F.lit('","gitRemotes":['), remotes, F.lit('],"gitRootCommits":['),
        root, F.lit('],"machineId":"'), machine_of(u), F.lit('","runtimeId":"'), runtime_of(u), F.lit('"}'),
    )
    end = F.concat(
        F.lit('{"durationMs":'), (F.col("monotonic_ms")).cast("string"), F.lit(',"exitCode":'),
        F.when(u % 5 != 0, (u % 3).cast("string")).otherwise("null"), F.lit("}"),
    )
    output = (
        F.when(k % 3 == 0, F.concat(
            F.lit('{"coverageProbe":{"commands":[{"command":"npm","status":"observed"},{"command":"git","status":"'),
            F.when(k % 2 == 0, "shadowed").otherwise("unknown"), F.lit('"}]}}')))
        .when(k % 3 == 1, F.concat(
            F.lit('{"recorder":"fs","recorderError":"limit '), k.cast("string"), F.lit('"}')))
        .otherwise(F.lit('{"command":"npm","ledgerlensInterference":true,"reason":"loop"}'))
    )
    exit_ = F.concat(
        F.lit('{"command":'), _quote(F.col("command")), F.lit(',"cwd":'), _quote(F.col("cwd")),
        F.lit(',"execId":'), _quote(F.col("exec_id")),
        F.lit(',"exitCode":'), _or_null(F.col("exit_code").cast("string")),
        F.coalesce(F.concat(F.lit(',"parentExecId":'), _quote(F.col("parent_exec_id"))), F.lit("")),
        F.coalesce(F.concat(F.lit(',"signal":'), _quote(F.col("signal"))), F.lit("")),
        F.lit("}"),
    )
    withheld = F.when((F.col("kind") == "file.write") & F.col("after_ref").isNull(), "oversized")
    file_ = F.concat(
        F.lit("{"),
        F.coalesce(F.concat(F.lit('"contentWithheld":'), _quote(withheld), F.lit(",")), F.lit("")),
        F.coalesce(F.concat(F.lit('"mtimeMs":'), F.col("mtime_ms").cast("string"), F.lit(",")), F.lit("")),
        F.lit('"path":'), _quote(F.col("path")), F.lit("}"),
    )
    status = F.concat(
        F.lit('{"branch":"main","dirtyAtEnd":'),
        F.when(~F.col("dirty_known"), "null")
        .when(F.col("dirty_count") == 0, "[]").when(F.col("dirty_count") == 1, '["src/a.py"]')
        .otherwise('["src/a.py","src/b.py"]'), F.lit("}"),
    )
    payload = (
        F.when(F.col("kind") == "session.start", start).when(F.col("kind") == "session.end", end)
        .when(F.col("kind") == "agent.output", output).when(F.col("kind") == "process.exit", exit_)
        .when(F.col("kind") == "git.status", status).otherwise(file_)
    )
    target = F.when(is_file, F.concat(
        F.lit('{"inScope":'), F.col("in_scope").cast("string"), F.lit(',"kind":"file","raw":'),
        _quote(F.col("path")), F.lit(',"resolved":'), _quote(F.col("path")), F.lit("}"),
    ))
    refs = F.concat(
        F.lit("{"), F.concat_ws(
            ",", F.concat(F.lit('"after":'), _quote(F.col("after_ref"))),
            F.concat(F.lit('"before":'), _quote(F.col("before_ref")))), F.lit("}"),
    )
    snapshot = F.when(
        (F.col("kind") == "file.write") & F.coalesce("after_ref", "before_ref").isNotNull(), refs
    )
    none = lambda t: F.lit(None).cast(t)
    return e.select(
        "id", "session_id", "ts", F.col("monotonic_ms").cast("bigint").alias("monotonic_ts"),
        F.lit("bridge").alias("source"), "signal_tier", "kind",
        F.concat(F.lit('{"kind":"agent","runtimeId":"'), runtime_of(u), F.lit('"}')).alias("actor"),
        target.alias("target"), none("string").alias("effect_class"),
        none("string").alias("blast_radius"), none("boolean").alias("reversible"),
        none("boolean").alias("taint"), none("string").alias("mission_id"),
        payload.alias("payload"), snapshot.alias("snapshot_ref"),
    )


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sealed ledger (schemas.RAW_EVENTS)."""
    return build_chain(ledger_drafts(spark, sf_dir), exact=False)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some users state about repositories and records, as link claims."""
    s = ledger_sessions(spark, sf_dir)
    u = F.col("number")
    repo = lambda n: F.concat(F.lit("evidence:repo/github.com/acme/r"), (n % 12).cast("string"))
    record = F.concat(F.lit("evidence:record/"), F.sha2(F.col("id").cast("binary"), 256))
    type_ = (
        F.when(u % 10 == 3, "identity:same-repo").when(u % 10 == 4, "identity:distinct-repos")
        .when(u % 10 == 5, "relates-to").when(u % 10 == 6, "mission")
    )
    from_ = F.when(u % 10 < 5, repo(u)).otherwise(record)
    to = (
        F.when(u % 10 == 3, repo(u + 1)).when(u % 10 == 4, repo(u + 4))
        .when(u % 10 == 5, F.concat(F.lit("evidence:record/"), F.sha2(F.concat(F.lit("u"), (u + 700).cast("string")).cast("binary"), 256)))
        .otherwise(F.concat(F.lit("https://tracker.example/"), u.cast("string")))
    )
    return s.where((u % 10).isin(3, 4, 5, 6)).select(
        F.concat(F.lit("user"), u.cast("string")).alias("author"), F.col("started_at").alias("ts"),
        type_.alias("type"), from_.alias("from"), to.alias("to"), F.lit("").alias("reason"),
    )


def retractions(made: DataFrame) -> DataFrame:
    """Every fifth author of identity links takes the link back."""
    number = F.regexp_extract("author", "([0-9]+)", 1).cast("bigint")
    return made.where((F.col("type") == "identity:same-repo") & (number % 5 == 3) & (number % 3 == 0)).select(
        "author", "ts", F.lit("retracts").alias("type"),
        F.concat(F.lit("evidence:link/"), "link_id").alias("from"),
        F.concat(F.lit("evidence:link/"), "link_id").alias("to"), F.lit("mistaken").alias("reason"),
    )
