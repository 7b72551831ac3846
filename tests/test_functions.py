import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import canon, classify, paths, redact, remotes


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_canonical_json(spark):
    cases = {
        '{"b":1,"a":{"d":[2,1],"c":null}}': '{"a":{"c":null,"d":[2,1]},"b":1}',
        '{"n":[1.0,1e3,1E21,1e-7,0.000001,123456789012345680000,-0.0,12345678.900000001]}':
            '{"n":[1,1000,1e+21,1e-7,0.000001,123456789012345680000,0,12345678.9]}',
        '{"s":"\\u001f\\ud800\\u00e9\\/"}': '{"s":"\\u001f\\ud800é/"}',
        '{"a":1,"a":2}': '{"a":2}',
        "[1,": None,
    }
    assert apply(spark, cases, canon.canonical_json) == list(cases.values())


def test_content_address_ignores_only_the_id(spark):
    docs = ['{"id":"x","b":{"id":"y"},"a":1e21}', '{"a":1e21,"b":{"id":"y"},"id":"other"}', '{"a":1e21,"b":{"id":"z"}}']
    first, second, third = apply(spark, docs, lambda c: canon.content_address(c, "id"))
    assert first == second != third


@pytest.mark.parametrize("form", ["expression", "staged", "json"])
def test_redaction(spark, form):
    cases = {
        "x https://me:pw@h/p": ("x https://me:[REDACTED]@h/p", 1),
        "Basic dXNlcjpwdw==": ("Basic [REDACTED]", 1),
        "A_TOKEN=a B=token=c": ("A_TOKEN=[REDACTED] B=token=c", 1),
        "PASSWORD=http://a:b@c": ("PASSWORD=[REDACTED]", 2),
        "SECRET=[REDACTED]": ("SECRET=[REDACTED]", 0),
        "GIT_COMMITTER_TOKEN=x --token=y": ("GIT_COMMITTER_TOKEN=x --token=y", 0),
        "é ghp_" + "a" * 36: ("é [REDACTED]", 1),
        "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----": ("[REDACTED]", 1),
        "plain": ("plain", 0),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    if form == "staged":
        out = redact.with_redaction(df, "t", "value", "count")
    elif form == "expression":
        out = df.select("i", redact.redact_text(F.col("t")).alias("r")).select("i", "r.*")
    else:
        out = df.select("i", redact.redact_json(F.to_json(F.struct("t"))).alias("r")).select(
            "i", F.get_json_object("r.value", "$.t").alias("value"), "r.count"
        )
    assert [(r["value"], r["count"]) for r in out.orderBy("i").collect()] == list(cases.values())


def test_args_consume_the_next_value_once(spark):
    args = [["--token", "--password", "x", "y"], ["-auth", "v", "w"], ["--secret=a\nb"]]
    out = apply(spark, args, redact.redact_args, "array<string>")
    assert [(r["value"], r["count"]) for r in out] == [
        (["--token", "--password", "[REDACTED]", "y"], 1), (["-auth", "[REDACTED]", "w"], 1),
        (["--secret=a\nb"], 0),
    ]


def test_remote_urls(spark):
    cases = {
        "ssh://git@h.example:2222/g/r.git": "h.example:2222/g/r", "git@H.example:g/r.git.git": "h.example/g/r.git",
        "http://h:80/a//": "h/a", "file:///x": None, "./x": None, "D:\\x": None, "https://h": None, "": None,
        "https://h:x/y": None, "h:p": "h/p",
    }
    assert apply(spark, cases, remotes.normalize_remote_url) == list(cases.values())
    stripped = apply(spark, ["https://a:b@c/d@e", "git@h:p", "u:t@h:p"], remotes.strip_url_credentials)
    assert stripped == ["https://c/d@e", "git@h:p", "h:p"]


def test_paths(spark):
    df = spark.createDataFrame(
        [("/p/", "/p/a/b"), ("/p", "/pq/a"), ("C:\\w", "c:/w/x\\y"), ("/p", "/p"), ("/p", "/p/")], "c string, p string"
    )
    out = [r[0] for r in df.select(paths.rel_path_of(F.col("c"), F.col("p"))).collect()]
    assert out == ["a/b", None, "x/y", None, None]
    assert apply(spark, [".//a", "./a", "\\a", "///b/c"], paths.query_path) == ["a", "a", "a", "b/c"]


def test_unknown_reversibility_stays_null(spark):
    out = apply(spark, ["node x", "git pull", "ls", "rm -rf x"], classify.classify_command)
    assert [r["reversible"] for r in out] == [None, None, True, False]
