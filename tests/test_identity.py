import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import components, identity as I

INPUTS = (
    "record_id string, session_id string, chain_head string, machine_id string, cwd string, runtime_id string, "
    "git_remotes array<struct<name:string,url:string>>, git_root_commits array<string>"
)


def evidence(spark, rows):
    full = [
        (rid, f"s-{rid}", "", "m1", cwd, "x", [("origin", o)] * bool(o) + [("up", u) for u in ups], roots)
        for rid, cwd, o, ups, roots in rows
    ]
    return I.evidence_from(spark.createDataFrame(full, INPUTS))


ROWS = [
    ("r1", "/a", "https://h/one", [], ["k1"]), ("r2", "/b", "git@h:one.git", [], []),
    ("r3", "/c", None, [], ["k1", "k2"]),          # offline clone: k1 belongs to one origin
    ("r4", "/d", "https://h/two", [], ["k3"]), ("r5", "/e", "https://h/three", ["https://h/two"], ["k3"]),
    ("r6", "/f", None, [], ["k3"]),                # two origins hold k3: stays alone
    ("r7", "/g", None, [], []), ("r8", "/g", None, [], []), ("r9", "/g", None, ["https://h/two"], []),
]


@pytest.mark.parametrize("backwards", [True])
def test_resolution_and_claims(spark, backwards):
    rows = ROWS[::-1] if backwards else ROWS
    directives = spark.createDataFrame([
        ("merge", "h/one", "h/two", "L1", "ann"), ("merge", "h/two", "k1", "L2", "bob"),
        ("merge", "h/none", "h/one", "L3", "bob"), ("distinct", "h/three", "h/two", "L4", "ann"),
        ("distinct", "h/one", "h/two", "L5", "ann"),
    ], I.DIRECTIVES)
    r = I.resolve(evidence(spark, rows), directives)
    rows_of = r.members.collect()
    members, by_label = {}, {}
    for m in rows_of:
        members.setdefault(m["display_name"], set()).add(m["record_id"])
        by_label.setdefault(m["label"], set()).add(m["record_id"])
    assert members["h/one"] == {"r1", "r2", "r3", "r4"} and members["h/three"] == {"r5"}
    assert members["root:k3"] == {"r6"}
    assert {"r7", "r8"} in by_label.values() and {"r9"} in by_label.values()
    g = {x["display_name"]: x for x in r.groups.collect()}
    assert g["root:k3"]["ambiguous"] and g["h/one"]["declared"] and g["h/one"]["root_conflict"]
    assert not g["h/three"]["root_conflict"] and g["h/one"]["origins"] == ["h/one", "h/two"]
    assert [x["link_id"] for x in r.applied.collect()] == ["L1"]
    assert {(x["link_id"], x["reason"]) for x in r.unresolved.collect()} == {
        ("L2", "redundant"), ("L3", "unresolvable"), ("L5", "unenforceable")}
    pairs = {(x["kind"], x["name_a"], x["name_b"], x["via"]) for x in I.candidate_pairs(r.holders, "h/three").collect()}
    assert ("lineage", "h/one", "h/three", "root k3") in pairs and ("shared-remote", "h/one", "h/three", "remote h/two") in pairs
    declared = r.declared_distinct.first()
    assert (declared["kind"], declared["declared_by"]) == ("lineage", "ann")
    assert I.find_group(r.groups, "https://H/one.git").first()["display_name"] == "h/one"
    assert I.find_group(r.groups, "root:k2").first()["display_name"] == "h/one"
    with pytest.raises(LookupError, match="matches 3 repository groups"):
        I.find_group(r.groups, "root:k")
    with pytest.raises(LookupError, match="no repository"):
        I.find_group(r.groups, "nothing")


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    hub = [("zhub", f"q{i:03d}") for i in range(60)]
    edges = spark.createDataFrame(path + hub, "a string, b string")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    labels = {(r["label"], r["n"]) for r in components.connected_components(nodes, edges).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert labels == {("p000", 61), ("q000", 61)}
