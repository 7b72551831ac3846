"""Which records belong to one repository.

Resolution fails toward splitting: only a shared ``origin``, a root held by exactly
one origin's repository, an otherwise unmarked directory, or a person's explicit
claim joins records.  Every other hint is kept as a candidate.

Graph steps run over distinct root commits and over repository groups, not over
records, so their size follows the number of repositories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.paths import path_key
from ledgerlens.functions.remotes import normalize_remote_url
from ledgerlens.operators.components import connected_components, spanning_forest
from ledgerlens.operators.ordered import attach, hash_salt
from ledgerlens.settings import settle

EVIDENCE_COLUMNS = (
    "record_id", "session_id", "chain_head", "machine_id", "cwd", "runtime_id", "origin",
    "remotes", "roots", "path_key",
)
DIRECTIVES = "kind string, a string, b string, link_id string, author string"


@dataclass(frozen=True)
class Resolution:
    groups: DataFrame
    members: DataFrame
    holders: DataFrame
    applied: DataFrame
    unresolved: DataFrame
    declared_distinct: DataFrame


def evidence_from(inputs: DataFrame) -> DataFrame:
    """Identity evidence from ``gitRemotes(name, url)`` and ``gitRootCommits``."""
    remotes = F.transform(
        F.coalesce("git_remotes", F.array().cast("array<struct<name:string,url:string>>")),
        lambda r: F.struct(r["name"].alias("name"), normalize_remote_url(r["url"]).alias("url")),
    )
    with_remotes = inputs.withColumn("_r", remotes)
    named_origin = F.filter("_r", lambda r: r["name"] == "origin")
    # A repeated name counts once, with its last url.
    last_of_name = F.filter(
        F.transform("_r", lambda r: F.struct(
            r["name"].alias("name"),
            F.element_at(F.filter("_r", lambda x: x["name"] == r["name"]), -1)["url"].alias("url"),
        )),
        lambda r: r["url"].isNotNull(),
    )
    return with_remotes.select(
        "record_id", "session_id", "chain_head", "machine_id", "cwd", "runtime_id",
        F.try_element_at(named_origin, F.lit(-1))["url"].alias("origin"),
        F.array_sort(F.array_distinct(F.transform(last_of_name, lambda r: r["url"]))).alias("remotes"),
        F.array_sort(F.array_distinct(F.coalesce("git_root_commits", F.array().cast("array<string>")))).alias("roots"),
        path_key(F.col("machine_id"), F.col("cwd")).alias("path_key"),
    )


def _label_without_claims(evidence: DataFrame) -> DataFrame:
    """``record_id, label, ambiguous`` before any declared merge."""
    salt = hash_salt("record_id")
    # G1: one label per origin.
    by_origin = evidence.where(F.col("origin").isNotNull()).groupBy("origin").agg(
        F.min("record_id").alias("origin_label")
    )
    # Origin-less records joined through shared roots.  The graph has one node per
    # root; a record with several roots contributes edges between them.
    rooted = evidence.where(F.col("origin").isNull() & (F.size("roots") > 0)).select(
        "record_id", "roots", F.array_min("roots").alias("first_root")
    )
    pairs = rooted.select(F.col("first_root").alias("a"), F.explode("roots").alias("b")).distinct()
    root_label = connected_components(pairs.select(F.col("b").alias("node")).distinct(), pairs).select(
        F.col("node").alias("root"), F.col("label").alias("component")
    )
    # How many origins the roots of a component also belong to.
    origin_roots = (
        evidence.where(F.col("origin").isNotNull())
        .select("origin", F.explode("roots").alias("root")).distinct()
        .join(by_origin, "origin").select("root", "origin_label")
    )
    adjacent = root_label.join(origin_roots, "root").groupBy("component").agg(
        F.min("origin_label").alias("low"), F.max("origin_label").alias("high")
    )
    placed = root_label.join(adjacent, "component", "left").select(
        F.col("root").alias("first_root"),
        F.when(F.col("low") == F.col("high"), F.col("low"))
        .otherwise(F.concat(F.lit("component:"), "component")).alias("root_group"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("ambiguous"),
    )
    # Unmarked directories.
    unmarked = F.col("origin").isNull() & (F.size("roots") == 0) & (F.size("remotes") == 0)
    by_path = evidence.where(unmarked).groupBy("path_key").agg(F.min("record_id").alias("path_label"))

    keyed = evidence.select(
        "record_id",
        "origin",
        F.when(F.col("origin").isNull() & (F.size("roots") > 0), F.array_min("roots")).alias("first_root"),
        F.when(unmarked, F.col("path_key")).alias("path_key"),
    )
    labelled = attach(
        attach(attach(keyed, by_origin, ["origin"], salt), placed, ["first_root"], salt),
        by_path, ["path_key"], salt,
    )
    return labelled.select(
        "record_id",
        F.coalesce("origin_label", "root_group", "path_label", "record_id").alias("label"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )


def signal_records(evidence: DataFrame, signals: DataFrame) -> DataFrame:
    """For each ``signals(signal)``, the smallest record that carries it."""
    forms = evidence.select("record_id", F.explode(F.concat(
        F.array_compact(F.array("origin")), "remotes", "roots",
        F.array("path_key", F.concat(F.lit("path:"), "path_key")),
    )).alias("signal")).groupBy("signal").agg(F.min("record_id").alias("record_id"))
    roots = evidence.select("record_id", F.explode("roots").alias("root")).groupBy("root").agg(
        F.min("record_id").alias("record_id")
    )
    prefixes = roots.select(
        "record_id",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.length("root")),
            lambda n: F.concat(F.lit("root:"), F.substr(F.col("root"), F.lit(1), n)),
        )).alias("signal"),
    )
    wanted = signals.distinct()
    return (
        forms.join(wanted, "signal")
        .unionByName(prefixes.join(wanted, "signal").select("signal", "record_id"))
        .groupBy("signal").agg(F.min("record_id").alias("record_id"))
    )


def resolve(evidence: DataFrame, directives: DataFrame | None = None) -> Resolution:
    """G1-G9 over ``evidence`` (EVIDENCE_COLUMNS) and ``directives`` (DIRECTIVES)."""
    spark = evidence.sparkSession
    if directives is None:
        directives = spark.createDataFrame([], DIRECTIVES)
    # One row per record, read by every step below.
    evidence = settle(evidence.select(*EVIDENCE_COLUMNS), "identity-evidence")
    labels = settle(_label_without_claims(evidence), "identity-labels")
    salt = hash_salt("record_id")

    # Each side of a claim is the group of its smallest matching record.
    wanted = directives.select(F.explode(F.array("a", "b")).alias("signal"))
    found = signal_records(evidence, wanted).join(
        labels.select("record_id", "label"), "record_id"
    )
    side = lambda c: found.select(
        F.col("signal").alias(c), F.col("record_id").alias(f"{c}_record"), F.col("label").alias(f"{c}_label")
    )
    claims = settle(
        directives.join(side("a"), "a", "left").join(side("b"), "b", "left"), "identity-claims"
    )
    merges = claims.where(F.col("kind") == "merge")
    known = F.col("a_label").isNotNull() & F.col("b_label").isNotNull()
    edges = merges.where(known).select(
        "link_id",
        F.collate("a", "UNICODE").alias("w1"), F.collate("b", "UNICODE").alias("w2"),
        F.col("link_id").alias("w3"),
        F.col("a_label").alias("a"), F.col("b_label").alias("b"),
    )
    in_forest = settle(
        spanning_forest(edges, ["w1", "w2", "w3"], "link_id").withColumn("applies", F.lit(True)),
        "identity-forest",
    )
    judged = merges.join(in_forest, "link_id", "left").withColumn(
        "outcome",
        F.when(~known, "unresolvable").when(F.col("applies"), "applied").otherwise("redundant"),
    )
    applied = judged.where(F.col("outcome") == "applied")
    joined = connected_components(
        applied.select(F.explode(F.array("a_label", "b_label")).alias("node")),
        applied.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")),
    ).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    declared_labels = joined.select(F.col("merged").alias("label"), F.lit(True).alias("declared")).distinct()
    final = settle(
        attach(labels, joined, ["label"], salt).select(
            "record_id", F.coalesce("merged", "label").alias("label"), "ambiguous"
        ),
        "identity-final",
    )
    members = evidence.join(final, "record_id")
    groups = settle(_materialise(members, declared_labels), "identity-groups")
    names = groups.select("label", "display_name", "basis")
    named_members = attach(
        members.select("record_id", "label"), names, ["label"], salt, "inner"
    )
    holders = _candidate_holders(groups)
    distinct, unresolved_distinct = _declare_distinct(claims, final, names, holders)
    unresolved = judged.where(F.col("outcome") != "applied").select(
        "kind", "a", "b", "link_id", "author", F.col("outcome").alias("reason")
    ).unionByName(unresolved_distinct)
    return Resolution(
        groups, named_members, holders,
        applied.select("kind", "a", "b", "link_id", "author"), unresolved, distinct,
    )


def _materialise(members: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per group."""
    first = F.min_by(F.struct("path_key", "ambiguous"), "record_id")
    base = members.groupBy("label").agg(
        F.min("record_id").alias("first_record"),
        F.count(F.lit(1)).alias("records"),
        F.array_sort(F.collect_set("origin")).alias("origins"),
        F.array_sort(F.collect_set(F.coalesce("machine_id", F.lit("unknown")))).alias("machines"),
        F.array_sort(F.collect_set("runtime_id")).alias("runtimes"),
        F.array_sort(F.collect_set("path_key")).alias("path_keys"),
        first.alias("f"),
    )
    sessions = members.select("label", "session_id", "chain_head").distinct().groupBy("label").agg(
        F.count(F.lit(1)).alias("session_count")
    )
    lists = (
        members.select("label", F.lit("remote").alias("k"), F.explode("remotes").alias("v"))
        .unionByName(members.select("label", F.lit("root").alias("k"), F.explode("roots").alias("v")))
        .groupBy("label").agg(
            F.array_sort(F.collect_set(F.when(F.col("k") == "remote", F.col("v")))).alias("remotes"),
            F.array_sort(F.collect_set(F.when(F.col("k") == "root", F.col("v")))).alias("roots"),
        )
    )
    empty = F.array().cast("array<string>")
    joined = (
        base.join(sessions, "label").join(lists, "label", "left")
        .join(_root_conflicts(members), "label", "left").join(declared, "label", "left")
        .withColumns({"remotes": F.coalesce("remotes", empty), "roots": F.coalesce("roots", empty)})
    )
    has_origin, has_root = F.size("origins") > 0, F.size("roots") > 0
    basis = F.when(has_origin, "origin").when(has_root, "root").otherwise("path")
    name = (
        F.when(has_origin, F.get("origins", F.lit(0)))
        .when(has_root, F.concat(F.lit("root:"), F.substring(F.get("roots", F.lit(0)), 1, 12)))
        .otherwise(F.concat(F.lit("path:"), F.col("f.path_key")))
    )
    return joined.select(
        "label", name.alias("display_name"), basis.alias("basis"), "first_record",
        "records", "session_count", "origins", "remotes", "roots", "machines", "runtimes",
        F.when(basis == "path", F.col("path_keys")).alias("path_keys"),
        (F.col("f.ambiguous") & (basis != "origin")).alias("ambiguous"),
        F.coalesce("root_conflict", F.lit(False)).alias("root_conflict"),
        F.coalesce("declared", F.lit(False)).alias("declared"),
    )


def _root_conflicts(members: DataFrame) -> DataFrame:
    """Groups whose root-bearing members do not connect through shared roots."""
    sep = F.lit("\u0001")
    held = members.where(F.size("roots") > 0).select(
        "label", F.array_min("roots").alias("first_root"), "roots"
    )
    pairs = held.select("label", "first_root", F.explode("roots").alias("root")).distinct()
    several = pairs.groupBy("label").agg(F.count_distinct("root").alias("n")).where(F.col("n") > 1)
    pairs = pairs.join(several.select("label"), "label", "left_semi")
    nodes = pairs.select(F.concat("label", sep, "root").alias("node"))
    edges = pairs.select(
        F.concat("label", sep, "first_root").alias("a"), F.concat("label", sep, "root").alias("b")
    )
    parts = connected_components(nodes, edges)
    return parts.groupBy(F.substring_index("node", "\u0001", 1).alias("label")).agg(
        (F.min("label") != F.max("label")).alias("root_conflict")
    )


def _candidate_holders(groups: DataFrame) -> DataFrame:
    """G8 in linear form: ``kind, via, label, display_name`` for every shared signal.

    Each two holders of one signal are a candidate; ``candidate_pairs`` spells out those
    of one repository, or all of them.
    """
    by_root = groups.where(F.size("origins") > 0).select(
        F.lit("lineage").alias("kind"), F.explode("roots").alias("value"), "label", "display_name"
    ).withColumn("via", F.concat(F.lit("root "), "value"))
    by_remote = groups.select(
        F.lit("shared-remote").alias("kind"),
        F.explode(F.array_union("remotes", "origins")).alias("value"), "label", "display_name",
    ).withColumn("via", F.concat(F.lit("remote "), "value"))
    rows = by_root.unionByName(by_remote).select("kind", "via", "label", "display_name")
    shared = rows.groupBy("kind", "via").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return attach(
        rows, shared.select("kind", "via"), ["kind", "via"], hash_salt("label"), "inner"
    )


def candidate_pairs(holders: DataFrame, display_name: str | None = None) -> DataFrame:
    """``kind, name_a, name_b, via``; with a name, only the pairs of that repository."""
    a = holders.select("kind", "via", F.col("label").alias("la"), F.col("display_name").alias("na"))
    b = holders.select("kind", "via", F.col("label").alias("lb"), F.col("display_name").alias("nb"))
    if display_name is not None:
        own = a.where(F.col("na") == display_name)
        pairs = own.join(b, ["kind", "via"]).where(F.col("la") != F.col("lb"))
    else:
        pairs = a.join(b, ["kind", "via"]).where(
            F.struct("na", "la") < F.struct("nb", "lb")
        )
    return pairs.select(
        "kind", F.least("na", "nb").alias("name_a"), F.greatest("na", "nb").alias("name_b"), "via"
    )


def _declare_distinct(
    claims: DataFrame, final: DataFrame, names: DataFrame, holders: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Each distinct claim closes the first open candidate of its pair."""
    named = final.join(names, "label").select("record_id", "display_name", "label")
    side = lambda c: named.select(
        F.col("record_id").alias(f"{c}_record"), F.col("display_name").alias(f"{c}_name")
    )
    d = (
        claims.where(F.col("kind") == "distinct").select("kind", "a", "b", "link_id", "author", "a_record", "b_record")
        .join(side("a"), "a_record", "left").join(side("b"), "b_record", "left")
        .withColumns({"name_a": F.least("a_name", "b_name"), "name_b": F.greatest("a_name", "b_name")})
    )
    both = F.col("a_name").isNotNull() & F.col("b_name").isNotNull()
    open_ = d.where(both & (F.col("a_name") != F.col("b_name"))).withColumn(
        "turn", F.row_number().over(Window.partitionBy("name_a", "name_b").orderBy("a", "b", "link_id"))
    )
    # Only the pairs that a claim names are looked up among the holders.
    pairs = open_.select("name_a", "name_b").distinct()
    at = lambda c: holders.select("kind", "via", F.col("display_name").alias(c), F.col("label").alias(f"{c}_l"))
    matches = (
        pairs.join(at("name_a"), "name_a").join(at("name_b"), ["kind", "via", "name_b"])
        .where(F.col("name_a_l") != F.col("name_b_l"))
        .select("name_a", "name_b", F.col("kind").alias("candidate_kind"), "via")
        .withColumn("turn", F.row_number().over(
            Window.partitionBy("name_a", "name_b").orderBy("candidate_kind", "via")
        ))
    )
    settled = open_.join(matches, ["name_a", "name_b", "turn"], "left")
    declared = settled.where(F.col("via").isNotNull()).select(
        F.col("candidate_kind").alias("kind"), "name_a", "name_b", "via",
        F.lit("distinct").alias("declared"), F.col("author").alias("declared_by"),
    )
    columns = ["kind", "a", "b", "link_id", "author", "reason"]
    left_over = settled.where(F.col("via").isNull()).withColumn("reason", F.lit("unresolvable")).select(*columns)
    rest = d.where(~both | (F.col("a_name") == F.col("b_name"))).withColumn(
        "reason", F.when(both, "unenforceable").otherwise("unresolvable")
    ).select(*columns)
    return declared, left_over.unionByName(rest)


def find_group(groups: DataFrame, argument: str) -> DataFrame:
    """The one group that a repository argument names, or an error.

    Display names and origins are strong; other signals are asked only when nothing
    strong matches.  Equally strong matches are refused.
    """
    forms = F.array_compact(F.array(F.lit(argument), normalize_remote_url(F.lit(argument))))
    strong = F.array_contains(forms, F.col("display_name")) | F.arrays_overlap("origins", forms)
    after = argument[5:]
    wide = F.arrays_overlap("remotes", forms) | F.arrays_overlap("roots", forms)
    if argument.startswith("root:"):
        wide = wide | F.exists("roots", lambda r: r.startswith(after))
    if argument.startswith("path:"):
        wide = wide | F.array_contains(F.coalesce("path_keys", F.array().cast("array<string>")), after)
    tier = F.when(strong, 1).when(wide, 2)
    matches = groups.withColumn("tier", tier).where(F.col("tier").isNotNull())
    counted = {r["tier"]: r["n"] for r in matches.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counted:
        raise LookupError(f'no repository matches "{argument}"')
    best = min(counted)
    if counted[best] > 1:
        shown = matches.where(F.col("tier") == best).orderBy("display_name").select("display_name")
        listed = ", ".join(r["display_name"] for r in shown.collect())
        raise LookupError(
            f'"{argument}" matches {counted[best]} repository groups ({listed}) — equally strong '
            "signals admit no choice; name one by its display name"
        )
    return matches.where(F.col("tier") == best).drop("tier")
