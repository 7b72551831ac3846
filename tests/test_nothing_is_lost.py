"""Malformed rows are answered, and nothing is cut, capped or nested out of sight."""

import json
import random

from pyspark.sql import functions as F

from ledgerlens.functions.redact import _is_json, _redact_document, redact_json
from ledgerlens.operators.diff import _align
from ledgerlens.operators.ordered import ordered_view

TOKEN = "ghp_" + "a1B2" * 9


def test_null_keys_and_orders_keep_their_rows(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), (None, 1, "n"), (None, None, "m")]
    df = spark.createDataFrame(rows, "k string, seq long, id string")
    got = ordered_view(df, ["k"], F.floor(F.col("seq") / 4096), ["seq", "id"], position="place", lags={"was": "id"})
    assert sorted((r.k or "", r.place, r.id, r.was or "") for r in got.collect()) == [
        ("", 1, "n", ""), ("", 2, "m", "n"), ("a", 1, "x", ""), ("a", 2, "y", "x"), ("a", 3, "z", "y"),
    ]


def test_secrets_are_found_at_any_depth(spark):
    for depth in (1, 14, 40, 20_000):
        text = "[" * depth + json.dumps({"k": f"token {TOKEN}"}) + "]" * depth
        clean, n = _redact_document(text)
        assert n == 1 and TOKEN not in clean and clean.startswith("[" * depth + "{") and clean.endswith("}" + "]" * depth)
    assert not _is_json('{"a": NaN}') and not _is_json("[1e400]") and _is_json('{"a": 1e4}')
    df = spark.createDataFrame([("[" * 20_000 + f'"{TOKEN}"' + "]" * 20_000,), (f'{{"{TOKEN}": 1}}',), (None,)], "t string")
    got = [r.r for r in df.select(redact_json(F.col("t")).alias("r")).collect()]
    assert got[0]["count"] == 1 and TOKEN not in got[0]["value"] and got[1]["count"] == 0


def test_diffs_are_shortest_and_rebuild_both_sides():
    r = random.Random(1)
    for _ in range(400):
        a, b = (["".join(r.choice("abc") for _ in range(1)) for _ in range(r.randrange(12))] for _ in range(2))
        script = _align("\n".join(a) if a else None, "\n".join(b) if b else None)
        assert [t for op, t in script if op != "+"] == a and [t for op, t in script if op != "-"] == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(op == " " for op, _ in script) == table[-1][-1]
    long = [str(i) for i in range(5000)]
    assert len(_align("\n".join(long), "\n".join(long[:2500] + ["new"] + long[2500:]))) == 5001
