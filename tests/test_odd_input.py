"""No single input stops a job: bad bytes, halves of surrogate pairs and rows without a time."""

import random

from pyspark.sql import functions as F

from ledgerlens.functions.redact import redact_json
from ledgerlens.operators import diff, links, record
from ledgerlens.plans.queries_stream import run_arrivals
from ledgerlens.sources.objects import read_object_files
from ledgerlens.streaming import ingest

START = 1_772_359_200_000


def test_files_that_are_no_text_are_refused_alone(spark, tmp_path):
    (tmp_path / "good.record.json").write_bytes(b'\xef\xbb\xbf{"a":1}')
    (tmp_path / "bad.record.json").write_bytes(b'{"a":"\xff\xfe"}')
    (tmp_path / "bad.html").write_bytes(b"<p>\xe9</p>")
    (tmp_path / "empty.json").write_bytes(b"")
    got = {r.source.rsplit("/", 1)[1]: (r.doc, list(r.errors)) for r in read_object_files(spark, str(tmp_path)).collect()}
    refused = (None, ["cannot read: the file is not valid UTF-8"])
    assert got == {"good.record.json": ('{"a":1}', []), "bad.record.json": refused, "bad.html": refused}


def test_blobs_that_are_no_text_are_compared_with_replacements(spark):
    blobs = spark.createDataFrame(
        [("x", 3, bytearray(b"a\n\xe9")), ("y", 3, bytearray(b"a\nb")), ("z", 0, bytearray())], "ref string, length long, content binary"
    )
    changes = spark.createDataFrame(
        [("s", "p", "available", None, "x", "y"), ("s", "q", "available", None, "y", "gone"), ("s", "r", "available", None, None, "z")],
        "session_id string, path string, content string, content_note string, before_ref string, after_ref string",
    )
    rows = diff.line_diff(diff.diff_inputs(changes, blobs)).orderBy("path", "line_no").collect()
    assert [(r.path, r.op, r.text) for r in rows] == [
        ("p", " ", "a"), ("p", "-", "\ufffd"), ("p", "+", "b"),
        ("q", "note", 'The "after" snapshot is no longer in the blob store.'), ("r", "+", ""),
    ]


def test_halves_of_surrogate_pairs_stay_escapes(spark):
    texts = [r'{"a":"\ud800 DB_PASSWORD=hunter2","\udfff":["\ud83d\ude00 DB_PASSWORD=x"]}', r'{"a":"\ud800"}', "DB_PASSWORD=x \ufffd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r.r) for r in df.select(redact_json(F.col("t")).alias("r")).collect()]
    assert got == [
        ('{"a":"\\ud800 DB_PASSWORD=[REDACTED]","\\udfff":["\U0001f600 DB_PASSWORD=[REDACTED]"]}', 2), (texts[1], 0),
        ("DB_PASSWORD=[REDACTED] \ufffd", 1),
    ]


def test_rows_without_a_time_do_not_stop_a_stream(spark):
    made = lambda *rows: spark.createDataFrame(
        list(rows), "session_id string, path string, id string, ts_ms long, before_ref string, after_ref string"
    )
    arrivals = [
        made(("s", "p", "1", START, "a", "b"), ("s", "p", "2", None, "b", "c"), (None, None, "3", None, None, None)),
        made(("s", "p", "4", None, "x", "y"), ("s", "p", "5", START + 50, "b", "c")),
        made(("end", "end", "6", START + 10_000_000, "a", "b")),
    ]
    rows = run_arrivals(spark, "odd-writes", arrivals, ingest.settled_writes).collect()
    assert [tuple(r) for r in rows] == [("s", "p", "5", START + 50, "a", "c")]
    refused = run_arrivals(spark, "odd-untimed", arrivals, ingest.untimed)
    assert [r.id for r in refused.collect()] == ["2", "4"]
    assert ingest.untimed(arrivals[0]).count() == 2
    made = lambda *rows: spark.createDataFrame(list(rows), "session_id string, kind string, ts_ms long")
    arrivals = [
        made(("s", "session.start", START), ("s", "session.end", None)), made(("s", "file.read", None)),
        made(("end", "session.end", START + 100_000_000)),
    ]
    rows = run_arrivals(spark, "odd-status", arrivals, ingest.session_status).collect()
    assert [tuple(r) for r in rows] == [("s", "stale", START)]


def test_large_boxes_are_cut_where_shortest_scripts_pass(monkeypatch):
    r = random.Random(4)
    for small in (0, 30):
        monkeypatch.setattr(diff, "SMALL_BOX", small)
        for _ in range(200):
            k = r.choice([2, 3, 20, 200])
            a = [str(r.randrange(k)) for _ in range(r.randrange(40))]
            b = list(a) if r.random() < 0.6 else [str(r.randrange(k)) for _ in range(r.randrange(40))]
            for _ in range(r.randrange(6)):
                b.insert(r.randrange(len(b) + 1), str(r.randrange(k))) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
            script = diff._align("\n".join(a) if a else None, "\n".join(b) if b else None)
            assert [t for op, t in script if op != "+"] == a and [t for op, t in script if op != "-"] == b
            row = [0] * (len(b) + 1)
            for x in a:
                last, row = row, [0]
                for j, y in enumerate(b):
                    row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
            assert sum(op == " " for op, _ in script) == row[-1]


def test_few_edits_in_long_files_are_found_quickly():
    r = random.Random(5)
    a = [str(r.randrange(5000)) for _ in range(200_000)]
    b = list(a)
    for _ in range(25):
        b.pop(r.randrange(len(b)))
        b.insert(r.randrange(len(b)), "new")
    script = diff._align("\n".join(a), "\n".join(b))
    assert sum(op != " " for op, _ in script) == 50
    assert [t for op, t in script if op != "+"] == a and [t for op, t in script if op != "-"] == b


def test_json_that_is_no_object_is_refused_among_others(spark):
    texts = ["[]", "[1]", "3", "1e400", "-0.0", '"x"', "true", "null", "", None, "{}", '[{"a":1e30}]', "nope", '{"recordId":[],"linkId":{}}']
    objects = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, doc string")
    for check in (record.check_records, links.check_links):
        rows = check(objects).collect()
        assert sorted(int(r.source) for r in rows) == list(range(len(texts)))
        assert {r.verdict for r in rows} == {"invalid"} and all(r.errors for r in rows)
