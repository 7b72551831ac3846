"""URL templates: small sections of large hosts, sections that differ far down, chance, and labels held out."""

from pyspark.sql import functions as F

from ledgerlens.llm import url_templates
from ledgerlens.llm.common import table

NO_RULES = (("allow", "none", "/"),)


def judged(spark, rows):
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    return {r.page_id: r for r in url_templates.judge(pages, NO_RULES).collect()}


def test_a_bad_section_is_blocked_on_a_host_of_any_size(spark):
    for good in (200, 6000):
        rows = [(f"http://h.org/news/{k}", False if k % 2 else None) for k in range(good)]
        rows += [(f"http://h.org/spam/{k}", True if k % 2 else None) for k in range(40)]
        got = judged(spark, rows)
        assert {got[i].verdict for i in range(good)} == {"allow"}
        assert {(got[i].template, got[i].verdict) for i in range(good, good + 40)} == {("/spam/*", "block")}


def test_sections_that_differ_far_down_are_told_apart(spark):
    start = "http://h.org/" + "a/" * 11
    rows = [(f"{start}{part}/{k}/x", part == "spam" if k % 2 else None) for part in ("news", "spam") for k in range(40)]
    got = judged(spark, rows)
    assert {got[i].verdict for i in range(40)} == {"allow"} and {got[i].verdict for i in range(40, 80)} == {"block"}
    assert {got[i].template for i in range(40, 80)} == {"/*" * 11 + "/spam/*/*"}


def test_paths_of_thousands_of_segments(spark):
    """Good and bad labels in one branch all the way down, with nothing to tell them apart before the last segment."""
    start = "http://h.org/" + "/".join(str(k % 3) for k in range(2000))
    rows = [(f"{start}/{part}/{k}", part == "spam") for part in ("news", "spam") for k in range(6)]
    got = judged(spark, rows)
    assert {(got[i].template, got[i].verdict) for i in range(6, 12)} == {("/*" * 2000 + "/spam/*", "block")}
    assert {got[i].verdict for i in range(6)} == {"allow"}


def test_a_section_of_four_is_enough_and_single_pages_are_not_learnt(spark):
    """Four bad pages make a literal section; at this share of bad labels the smoothing blocks six of them, not four."""
    rows = [(f"http://h.org/p/{k}", k == 7) for k in range(200)] + [(f"http://h.org/few/{k}", True) for k in range(4)]
    rows += [(f"http://h.org/six/{k}", True) for k in range(6)]
    got = judged(spark, rows)
    prior = 11 / 210
    shares = {"/p/*": (1 + 5 * prior) / 205, "/few/*": (4 + 5 * prior) / 9, "/six/*": (6 + 5 * prior) / 11}
    for few, template, verdict in ((range(200), "/p/*", "allow"), (range(200, 204), "/few/*", "allow"), (range(204, 210), "/six/*", "block")):
        assert {(got[i].template, got[i].verdict) for i in few} == {(template, verdict)}
        assert all(abs(got[i].bad_share - shares[template]) < 1e-12 for i in few)


def test_splits_below_splits_and_a_segment_that_is_a_star(spark):
    rows = [(f"http://h.org/{a}/x/{b}/{k}", bad) for k in range(30) for a, b, bad in (
        ("shop", "ads", True), ("shop", "items", False), ("*", "ads", True), ("*", "items", True), ("news", "ads", False), ("news", "items", False),
    )]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "block", "block", "allow", "allow"]
    assert got[2].template.startswith("/\\*/")


def test_verdicts_on_labels_held_out(spark):
    """Half of the documents' labels are hidden; pages of hidden labels are judged by the others."""
    sf_dir = "/root/testdata/sf0.1"
    pages = url_templates.labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    hidden = F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(2)) == 0
    shown = pages.withColumn("bad", F.when(~hidden, F.col("bad")))
    said = url_templates.judge(shown, NO_RULES).select("page_id", "verdict")
    by = {(r.bad, r.verdict): r["count"] for r in pages.where(hidden & F.col("bad").isNotNull()).join(said, "page_id").groupBy("bad", "verdict").count().collect()}
    most = max(sum(n for (bad, _), n in by.items() if bad == want) for want in (True, False))
    right = by.get((True, "block"), 0) + by.get((False, "allow"), 0)
    assert right >= most
