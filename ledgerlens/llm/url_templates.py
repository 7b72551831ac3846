"""URL filters by a tree of path templates.

Per host, paths are read segment by segment.  A segment stays literal where its
labelled pages differ, statistically, from the rest of its branch; all others share one
wildcard branch.  A template is judged by the smoothed share of bad labels.

A branch is read at all its depths at once, down to the first one where a segment
becomes literal; so a round ends at a split, and rounds follow the number of nested
splits, not the length of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import attach, hash_salt
from ledgerlens.settings import settle

# Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: How often a branch may, by chance alone, have a literal segment at one depth.
CHANCE = 0.05
PRIOR_PAGES = 5.0
BAD_SHARE = 0.5


def address(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lowered) and path; both empty without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cut, path = F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2)
    lowered = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct(verdict, rule)``, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = None
    for verdict, name, start in ordered:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        said = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out


def paths(pages: DataFrame) -> DataFrame:
    """Distinct ``(host, path)`` with their number of pages, labelled pages and bad pages."""
    return pages.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.sum(F.col("bad").cast("int")).alias("bad"),
    ).withColumn("bad", F.coalesce("bad", F.lit(0)))


def chance_bound() -> Column:
    """Logarithm of a bound on the chance of a section's labels at the rate of the rest (Chernoff's bound of binomial tails)."""
    rest_labelled, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    good = F.col("labelled") - F.col("bad")
    rate = (rest_bad + 1) / (rest_labelled + 2)
    likelihood = lambda n, p: F.when(n > 0, n * F.log(p * F.col("labelled") / n)).otherwise(F.lit(0.0))
    return likelihood(F.col("bad"), rate) + likelihood(good, 1 - rate)


def literal_segments(live: DataFrame) -> DataFrame:
    """``branch, level, part``: the literal segments of each branch at the first level that has any.

    A segment is literal if the rest of its branch at that level has labels too, and the
    chance of its own, times the number of labelled segments beside it, is below ``CHANCE``.
    """
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    child = live.where("labelled > 0").select(
        "branch", "level", "labelled", "bad", F.posexplode(F.slice("parts", F.col("level") + 1, F.size("parts"))).alias("at", "part")
    ).withColumn("level", F.col("level") + F.col("at")).groupBy("branch", "level", "part").agg(*sums)
    child = settle(child, "url-sections")
    node = child.groupBy("branch", "level").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("sections")
    ).where("all_bad > 0 AND all_bad < all_labelled AND sections > 1")
    apart = chance_bound() + F.log("sections") < F.log(F.lit(CHANCE))
    found = settle(attach(child, node, ["branch", "level"], hash_salt("part"), "inner").where(apart).select("branch", "level", "part"), "url-literals")
    first = found.groupBy("branch").agg(F.min("level").alias("level"))
    return attach(found, first, ["branch", "level"], hash_salt("part"), "inner").select("branch", "level", "part")


def templates(distinct: DataFrame) -> DataFrame:
    """``host, path, template`` with the counts of the path; other segments than literal ones are ``*``."""
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(F.col("path"), 2, 1 << 30), "/", -1))
    names = ["host", "path", "pages", "labelled", "bad", "template"]
    branch = F.md5(F.concat("host", "template"))  # no host holds a slash
    live = distinct.withColumn("parts", parts).withColumns({"template": F.lit(""), "level": F.lit(0)})
    live = settle(live.withColumn("branch", branch), "url-paths")
    literal_name = F.when(F.col("part") == "*", r"\*").otherwise(F.col("part"))
    out = None
    while True:
        literal = settle(literal_segments(live), "url-splits")
        split = literal.select("branch", F.col("level").alias("at")).distinct()
        rows = attach(live, split, ["branch"], hash_salt("path")).withColumn("part", F.get("parts", F.col("at")))
        rows = attach(rows, literal.select("branch", "part", F.lit(True).alias("literal")), ["branch", "part"], hash_salt("path"))
        deep = F.size("parts")
        wild = lambda n: F.repeat(F.lit("/*"), n.cast("int"))
        on = F.col("at").isNotNull() & (F.col("at") < deep)
        step = F.when(~on, wild(deep - F.col("level"))).otherwise(F.concat(
            wild(F.col("at") - F.col("level")), F.when(F.col("literal"), F.concat(F.lit("/"), literal_name)).otherwise("/*")
        ))
        rows = settle(rows.select(
            "host", "path", "pages", "labelled", "bad", F.concat("template", step).alias("template"), "parts",
            F.when(on, F.col("at") + 1).otherwise(deep).cast("int").alias("level"),
        ).withColumn("branch", branch), "url-templates")
        ended = rows.where(F.col("level") >= F.size("parts")).select(*names)
        out = ended if out is None else out.unionByName(ended)
        live = rows.where(F.col("level") < F.size("parts"))
        if live.isEmpty():
            return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the page's template and smoothed bad share.

    ``pages`` has ``page_id, url`` and ``bad`` (boolean, null where unlabelled).  A null
    url or one without ``://`` has an empty host and path and is judged like any other
    path; null ids and repeated rows are answered row by row; an empty table gives no
    rows; other columns are ignored.
    """
    host, path = address(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "bad")
    named = templates(paths(rows))
    prior = named.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("prior"))
    tallied = named.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    purity = tallied.crossJoin(prior).withColumn(  # one row
        "bad_share",
        (F.col("bad") + F.coalesce("prior", F.lit(0.0)) * PRIOR_PAGES) / (F.col("labelled") + PRIOR_PAGES),
    ).select("host", "template", "bad_share")
    judged = attach(named.select("host", "path", "template"), purity, ["host", "template"], hash_salt("path"))
    out = attach(rows.drop("bad"), judged, ["host", "path"], hash_salt("page_id"))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") >= BAD_SHARE, "block").otherwise("allow")
    return out.withColumn("said", rule).select(
        "page_id", "host", "path", F.col("said.rule").alias("rule"), F.coalesce("said.verdict", method).alias("verdict"),
        "template", "bad_share",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``bad`` from the labels of the document whose number ends the page's path."""
    _, path = address(F.col("url"))
    number = F.expr("try_cast(regexp_extract(_path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)")
    rows = pages.select("page_id", "url", path.alias("_path")).withColumn("doc_id", number)
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")
    )
    return rows.join(bad, "doc_id", "left").select("page_id", "url", "bad")
