"""Files are read some folders at a time, and contents of changes move once."""

import hashlib

from pyspark.sql import functions as F

from ledgerlens.operators import diff
from ledgerlens.plans import queries_report, queries_text
from ledgerlens.sources import blobs, files
from ledgerlens.sources.objects import read_object_files


def tree(tmp_path, folders, each):
    for d in range(folders):
        at = tmp_path / f"d{d}" / "in[1]"
        at.mkdir(parents=True)
        for n in range(each):
            (at / f"{n}.json").write_text(f'{{"d":{d},"n":{n}}}')
    (tmp_path / "top.json").write_text("{}")
    (tmp_path / "{odd}").mkdir()
    (tmp_path / "{odd}" / "x.json").write_text("[]")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.json").write_text("no")
    return folders * each + 2


def test_no_listing_holds_all_files(spark, tmp_path, monkeypatch):
    total = tree(tmp_path, 12, 5)
    monkeypatch.setattr(files, "FILES_AT_ONCE", 20)
    seen, plain = [], files.files_below

    def noting(session, *paths):
        found = plain(session, *paths)
        seen.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(files, "files_below", noting)
    read = read_object_files(spark, str(tmp_path))
    assert read.count() == total == sum(seen) and max(seen) <= 20
    assert {r.doc for r in read.where("source like '%odd%' or source like '%top%'").collect()} == {"{}", "[]"}
    manifest = blobs.blob_manifest(spark, str(tmp_path), max_bytes=2)
    assert manifest.count() == total and manifest.where("oversized").count() == total - 2
    kept = blobs.blob_table(spark, str(tmp_path))
    assert kept.count() == total and {bytes(r.content) for r in kept.where("length = 2").collect()} == {b"{}", b"[]"}
    assert spark.conf.get("spark.sql.files.openCostInBytes") != files.READING["spark.sql.files.openCostInBytes"]


def test_one_folder_or_file_or_none(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    for n in range(3):
        (tmp_path / "flat" / f"{n}.json").write_text("{}")
    assert read_object_files(spark, str(tmp_path / "flat")).count() == 3
    assert read_object_files(spark, str(tmp_path / "flat" / "1.json")).count() == 1
    assert read_object_files(spark, str(tmp_path / "flat" / "[01].json")).count() == 2
    (tmp_path / "empty").mkdir()
    assert read_object_files(spark, str(tmp_path / "empty")).count() == 0


def test_pages_of_one_number_share_a_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "é")], "page_id long, html string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    path = queries_text.page_files(spark, str(tmp_path))
    held = {p: bytes(c) for p, c in files.files_below(spark, path).select(queries_text._page_of(F.col("path")), "content").collect()}
    assert set(held) == {1, 2, 3} and held[2] == b"\n" and held[3] == b'\xef\xbb\xbf{"page":3}\n'
    assert held[1].count(b"<p>a<script") == 2 and held[1].endswith(b"</script>\n")


def changes(spark, rows):
    return spark.createDataFrame([("s", p, "available", None, b, a) for p, b, a in rows],
                                 "session_id string, path string, content string, content_note string, before_ref string, after_ref string")


def test_contents_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(diff, "POPULAR", 5)
    rows = [(f"p{n}", "hot" if n % 3 == 0 else f"b{n}", f"b{n + 1}" if n % 7 else None) for n in range(60)] + [("gone", "no", "b3")]
    held = spark.createDataFrame([(f"b{n}", bytearray(f"text {n}".encode())) for n in range(70)] + [("hot", bytearray(b"hot"))], "ref string, content binary")
    for listed in (rows, [r for r in rows if r[1] != "hot"]):
        got = {r.path: (r.before, r.after, r.reason) for r in diff.diff_inputs(changes(spark, listed), held).collect()}
        text = lambda ref: None if ref in (None, "no") else "hot" if ref == "hot" else f"text {ref[1:]}"
        gone = 'The "before" snapshot is no longer in the blob store.'
        assert got == {p: (text(b), text(a), gone if b == "no" else None) for p, b, a in listed}
    plan = diff.line_diff(diff.diff_inputs(changes(spark, rows[1:2]), held))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_texts_are_rebuilt_from_runs_and_from_pieces(spark):
    line = lambda path, n, op, text: ("s", path, n, op, text)
    rows = [line("a", 0, "-", "1"), line("a", 1, " ", "2"), line("a", 2, "+", "3"), line(None, 0, "note", "same"),
            line("b", 2, "+", "z"), line("b", 0, "+", "x"), line("c", 0, "+", "x"), line("b", 1, "+", "y"), line("c", 0, "+", "x")]
    lines = spark.createDataFrame(rows, "session_id string, path string, line_no int, op string, text string").coalesce(1)
    got = {r.path: tuple(r)[1:] for r in queries_report.rebuilt_texts(lines).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {
        "a": (2, 2, 0, sha("1\n2"), sha("2\n3")), None: (0, 0, 1, sha(""), sha("")),
        "b": (0, 3, 0, sha(""), sha("x\ny\nz")), "c": (0, 2, 0, sha(""), sha("x\nx")),
    }
