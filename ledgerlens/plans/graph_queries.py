"""The named queries over a collection of records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.addresses import cite, cite_link
from ledgerlens.functions.paths import query_path
from ledgerlens.operators.identity import Resolution, candidate_pairs, find_group, resolve
from ledgerlens.operators.links import (
    dangling_links, derive_directives, retracted_ids, touching_links,
)
from ledgerlens.operators.ordered import attach, hash_salt

CLOCK_NOTE = "times are stated by each machine’s clock, not proven by the chain"
ABSENCE_NOTE = "absence of records is not absence of activity"


@dataclass(frozen=True)
class Graph:
    """Extracted tables with the resolution of their repositories.

    ``primaries`` holds one elected record per session; ``unreadable`` is one row.
    Repositories are resolved when a query first asks for them, and once per graph.
    """

    records: DataFrame
    file_events: DataFrame
    facts: DataFrame
    links: DataFrame
    unreadable: DataFrame
    evidence: DataFrame
    primaries: DataFrame

    @cached_property
    def resolution(self) -> Resolution:
        return resolve(self.evidence, derive_directives(self.links))


def signals_as_evidence(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Records with their signals gathered back into arrays."""
    from ledgerlens.functions.paths import path_key

    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))
    gathered = signals.groupBy("record_id").agg(
        F.max(F.when(F.col("kind") == "origin", F.col("value"))).alias("origin"),
        pick("remote").alias("remotes"), pick("root").alias("roots"),
    )
    empty = F.array().cast("array<string>")
    return records.join(gathered, "record_id", "left").select(
        "record_id", "session_id", "chain_head", "machine_id", "cwd", "runtime_id", "origin",
        F.coalesce("remotes", empty).alias("remotes"), F.coalesce("roots", empty).alias("roots"),
        path_key(F.col("machine_id"), F.col("cwd")).alias("path_key"),
    )


def elect_primaries(records: DataFrame) -> DataFrame:
    """A5: per session and chain head, the record of the greatest generator."""
    order = F.struct(
        F.collate("generator_name", "UNICODE"), F.collate("generator_version", "UNICODE"), "record_id"
    )
    return records.groupBy("session_id", "chain_head").agg(
        F.max_by("record_id", order).alias("record_id"),
        (F.count(F.lit(1)) - 1).alias("reanalyses"),
    )


def open_graph(
    records: DataFrame, evidence: DataFrame, file_events: DataFrame, facts: DataFrame,
    links: DataFrame, unreadable: DataFrame,
) -> Graph:
    return Graph(records, file_events, facts, links, unreadable, evidence, elect_primaries(records))


def _session() -> Column:
    return F.struct("session_id", "chain_head")


def coverage_block(g: Graph, rows: DataFrame) -> DataFrame:
    """A2: what a report is based on, as one row."""
    counted = rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(_session()).alias("sessions"),
        F.array_sort(F.collect_set(F.coalesce("machine_id", F.lit("unknown")))).alias("machines"),
        F.array_sort(F.collect_set("runtime_id")).alias("agents"),
        F.min("started_at").alias("earliest"),
        F.max("started_at").alias("latest"),
    )
    one = F.lit(1).alias("_k")
    return counted.select("*", one).join(g.unreadable.select("unreadable", one), "_k").select(
        *counted.columns, F.col("unreadable").alias("unreadable_objects"),
        F.lit(CLOCK_NOTE).alias("clock_note"), F.lit(ABSENCE_NOTE).alias("note"),
    )


def _primary_rows(g: Graph, rows: DataFrame) -> DataFrame:
    return rows.join(g.primaries.select("record_id", "reanalyses"), "record_id")


def _member_rows(g: Graph, group: DataFrame) -> DataFrame:
    """Records of one group; ``group`` is a single row, so the join is a filter."""
    ids = g.resolution.members.join(group.select("label"), "label", "left_semi")
    return g.records.join(ids.select("record_id"), "record_id", "left_semi")


def _named(g: Graph, rows: DataFrame) -> DataFrame:
    """Rows with the name of their repository."""
    named = rows.join(
        g.resolution.members.select("record_id", F.col("display_name").alias("repo")), "record_id", "left"
    )
    return named.withColumn("repo", F.coalesce("repo", F.lit("unknown")))


def _machine() -> Column:
    return F.coalesce("machine_id", F.lit("unknown")).alias("machine")


def _generator() -> Column:
    return F.concat_ws(" ", "generator_name", "generator_version").alias("generator")


def repos(g: Graph) -> dict[str, DataFrame]:
    """Q1."""
    starts = g.resolution.members.select("record_id", "label").join(
        g.records.select("record_id", "started_at"), "record_id"
    ).groupBy("label").agg(
        F.min("started_at").alias("first_started_at"), F.max("started_at").alias("last_started_at")
    )
    groups = g.resolution.groups.join(starts, "label").select(
        "display_name", "basis", "origins", "remotes", "roots", "ambiguous", "root_conflict",
        "declared", F.col("session_count").alias("sessions"), "records", "machines",
        F.col("runtimes").alias("agents"), "first_started_at", "last_started_at",
    )
    return {
        "groups": groups,
        "candidate_holders": g.resolution.holders.select("kind", "via", "display_name"),
        "declared_distinct": g.resolution.declared_distinct,
        "applied_merges": g.resolution.applied.withColumn("cite", cite_link(F.col("link_id"))),
        "unresolved": g.resolution.unresolved.withColumn("cite", cite_link(F.col("link_id"))),
        "coverage": coverage_block(g, g.records).withColumn("_k", F.lit(1)).join(
            g.resolution.groups.agg(F.count(F.lit(1)).alias("groups")).withColumn("_k", F.lit(1)), "_k"
        ).drop("_k"),
    }


def candidates(g: Graph, repo: str | None = None) -> DataFrame:
    """J14 with what people have declared about each pair."""
    name = None if repo is None else find_group(g.resolution.groups, repo).first()["display_name"]
    pairs = candidate_pairs(g.resolution.holders, name)
    return pairs.join(g.resolution.declared_distinct, ["kind", "name_a", "name_b", "via"], "left")


def repo_history(g: Graph, repo: str) -> dict[str, DataFrame]:
    """Q2: primary sessions of one repository in time order."""
    group = find_group(g.resolution.groups, repo)
    rows = _member_rows(g, group)
    sessions = _primary_rows(g, rows).select(
        "started_at", "ended_at", F.col("runtime_id").alias("agent"), _machine(), _generator(),
        "integrity_status", F.col("event_count").alias("events"), F.col("fact_count").alias("facts"),
        "reanalyses", cite(F.col("record_id")).alias("cite"),
    ).orderBy("started_at", "cite")
    return {
        "repo": group.select("display_name", "basis", "root_conflict"),
        "sessions": sessions, "coverage": coverage_block(g, rows),
    }


def file_history(g: Graph, repo: str, path: str) -> dict[str, DataFrame]:
    """Q3: every change of one file in one repository, across machines and path styles."""
    group = find_group(g.resolution.groups, repo)
    rows = _member_rows(g, group)
    primary = _primary_rows(g, rows)
    wanted = query_path(F.lit(path))
    changes = (
        g.file_events.where(F.col("rel_path") == wanted)
        .join(primary.select("record_id", "runtime_id", "machine_id", "started_at"), "record_id")
        .select(
            F.col("occurred_ts").alias("occurred_at"), "occurred_source", "kind",
            F.col("runtime_id").alias("agent"), _machine(),
            F.col("started_at").alias("session_started_at"), "bytes_before", "bytes_after",
            "content_withheld", cite(F.col("record_id"), F.col("seq")).alias("cite"),
            "record_id", "seq",
        )
        .orderBy("occurred_at", "record_id", "seq")
        .drop("record_id", "seq")
    )
    excluded = (
        g.file_events.where(F.col("in_scope") & F.col("rel_path").isNull())
        .join(primary.select("record_id"), "record_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("excluded_unrelatable"))
    )
    return {"changes": changes, "excluded": excluded, "coverage": coverage_block(g, rows)}


def divergences(g: Graph, repo: str | None = None, rf: str | None = None) -> dict[str, DataFrame]:
    """Q4: facts of primary records with citations, and what each generator evaluated."""
    rows = g.records if repo is None else _member_rows(g, find_group(g.resolution.groups, repo))
    scope = _primary_rows(g, rows)
    facts = g.facts if rf is None else g.facts.where(F.col("fact_id") == rf)
    found = facts.select("record_id", "ord", "fact_id", "statement", "ts", "evidence").join(
        _named(g, scope).select("record_id", "repo", "runtime_id", "machine_id", "generator_name", "generator_version"),
        "record_id",
    )
    listed = found.select(
        "ts", "fact_id", "statement", "repo", F.col("runtime_id").alias("agent"), _machine(),
        _generator(),
        F.transform("evidence", lambda p: cite(F.col("record_id"), p["eventSeq"])).alias("citations"),
        "record_id", "ord",
    ).orderBy("ts", "record_id", "ord").drop("record_id", "ord")
    catalogs = scope.groupBy(_generator()).agg(F.min_by("catalog", "record_id").alias("catalog"))
    out = {"divergences": listed, "catalogs": catalogs, "coverage": coverage_block(g, scope)}
    if rf is not None:
        n = F.count_if(~F.array_contains("catalog", rf))
        out["not_evaluated"] = scope.agg(n.alias("sessions")).where("sessions > 0").select(
            F.lit(rf).alias("fact_id"), "sessions",
            F.concat(
                F.col("sessions").cast("string"),
                F.lit(f" session(s) were analyzed by a generator that never evaluates {rf} "
                      "— their silence is not absence"),
            ).alias("note"),
        )
    return out


def fact_ids(facts: DataFrame) -> DataFrame:
    """The fact ids of a record in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "fact_id")))
    return facts.groupBy("record_id").agg(F.transform(listed, lambda x: x["fact_id"]).alias("fact_ids"))


def timeline(
    g: Graph, machine: str | None = None, agent: str | None = None,
    since: str | None = None, until: str | None = None,
) -> dict[str, DataFrame]:
    """Primary sessions that pass the filters; coverage is of those rows."""
    rows = _primary_rows(g, g.records)
    if machine:
        rows = rows.where(F.coalesce("machine_id", F.lit("unknown")) == machine)
    if agent:
        rows = rows.where(F.col("runtime_id") == agent)
    if since:
        rows = rows.where(F.col("started_at") >= since)
    if until:
        rows = rows.where(F.col("started_at") <= until)
    ids = fact_ids(g.facts.join(rows.select("record_id"), "record_id", "left_semi"))
    empty = F.array().cast("array<string>")
    sessions = _named(g, rows).join(ids, "record_id", "left").select(
        "started_at", "ended_at", "repo", F.col("runtime_id").alias("agent"), _machine(), _generator(),
        "integrity_status", F.col("event_count").alias("events"), F.col("fact_count").alias("facts"),
        F.coalesce("fact_ids", empty).alias("fact_ids"), "reanalyses",
        cite(F.col("record_id")).alias("cite"),
    ).orderBy("started_at", "cite")
    return {"sessions": sessions, "coverage": coverage_block(g, rows)}


def tally(rows: DataFrame, key: Column) -> DataFrame:
    """A3: first and last seen, distinct sessions and records of each key.

    Sessions are made distinct first, so one busy key is spread over its sessions.
    """
    per_session = rows.groupBy(key, "session_id", "chain_head").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
        F.count(F.lit(1)).alias("records"),
    )
    name = per_session.columns[0]
    return per_session.groupBy(name).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("sessions"), F.sum("records").alias("records"),
    )


def coverage(g: Graph) -> dict[str, DataFrame]:
    """Q6."""
    by_repo = attach(
        g.resolution.members.select("record_id", "label"),
        g.resolution.groups.select("label", "display_name", "basis", "session_count"),
        ["label"], hash_salt("record_id"), "inner",
    ).join(g.records.select("record_id", "started_at"), "record_id")
    degraded = _primary_rows(g, g.records).where(F.col("integrity_status") == "DEGRADED")
    return {
        "machines": tally(g.records, _machine()),
        "agents": tally(g.records, F.col("runtime_id").alias("agent")),
        "repos": by_repo.groupBy("label", "display_name", "basis", "session_count").agg(
            F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
            F.count(F.lit(1)).alias("records"),
        ).drop("label").withColumnRenamed("session_count", "sessions"),
        "degraded_sessions": degraded.agg(F.count_distinct(_session()).alias("degraded_sessions")),
        "coverage": coverage_block(g, g.records),
    }


def links(g: Graph, repo: str | None = None) -> dict[str, DataFrame]:
    """Q7: links with what became of them."""
    rows = g.links
    if repo is not None:
        group = find_group(g.resolution.groups, repo)
        signals = group.select(F.explode(F.array_distinct(F.concat(
            F.array("display_name"), "origins", "remotes", "roots"
        ))).alias("value"))
        members = g.resolution.members.join(group.select("label"), "label", "left_semi")
        rows = touching_links(rows, signals, members.select("record_id"))
    flag = lambda ids, name: ids.select("link_id", F.lit(True).alias(name))
    dangling = dangling_links(rows, g.records, g.links)
    listed = (
        rows.join(flag(retracted_ids(g.links), "retracted"), "link_id", "left")
        .join(flag(dangling, "dangling"), "link_id", "left")
        .select(
            "link_id", "type", "author", "ts", "from", "to", "reason",
            F.coalesce("retracted", F.lit(False)).alias("retracted"),
            F.coalesce("dangling", F.lit(False)).alias("dangling"),
        )
        .orderBy("ts", "link_id")
    )
    return {
        "links": listed,
        "applied_merges": g.resolution.applied, "unresolved": g.resolution.unresolved,
        "coverage": coverage_block(g, g.records),
    }
