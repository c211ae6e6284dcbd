"""Sources and sinks."""

import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge import runtime
from tallyforge.plans import model_queries as M
from tallyforge.plans import report as R
from tallyforge.runtime import table
from tallyforge.sources import pages, sinks

DATA = "/root/testdata/sf0.001"


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\fthree")
    (tmp_path / "b.txt").write_text("")
    got = {(r.file_id.rsplit("/", 1)[1], r.page): r.text for r in pages.text_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1): "one\ntwo", ("a.txt", 2): "three"}  # an empty file has no page


def test_cached_pages(spark, tmp_path):
    line = lambda t: {"text": t, "bbox": [0, 0, 1, 1], "confidence": 0.9}
    for d in ("meta", "read"):
        (tmp_path / d).mkdir()
    meta = {"file": "x.pdf", "pages": [{"page": 1, "width": 1, "height": 1, "native": True, "lines": [line("own")]}, {"page": 2, "width": 1, "height": 1, "native": False, "lines": []}]}
    (tmp_path / "meta" / "a.json").write_text(json.dumps(meta))
    (tmp_path / "meta" / "bad.json").write_text("{not json")
    (tmp_path / "read" / "2.json").write_text(json.dumps({"file": "x.pdf", "page": 2, "lines": [line("read")]}))
    got = {(r.file_id, r.page): (r.native, [x.text for x in r.lines or []], r.error) for r in pages.cached_pages(spark, str(tmp_path / "meta"), str(tmp_path / "read")).collect()}
    assert got == {("x.pdf", 1): (True, ["own"], None), ("x.pdf", 2): (False, ["read"], None), (None, None): (False, [], "unreadable cache file")}


def test_delimited_rows(spark, tmp_path):
    (tmp_path / "rows.csv").write_bytes("\ufeffway,descr\r\n1,\"a, \"\"b\"\"\"\r\n2\r\n3,x\r\n".encode())
    got = {r.way: (r.descr, r._corrupt is not None) for r in pages.delimited(spark, str(tmp_path), "way string, descr string").collect()}
    assert got["1"] == ('a, "b"', False) and got["3"] == ("x", False) and got["2"] == (None, True)


def test_binary_pages(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    (tmp_path / "q.txt").write_bytes(b"no")
    assert [(r.length, bytes(r.content)) for r in pages.binary_pages(spark, str(tmp_path), "*.png").collect()] == [(4, b"\x89PNG")]


def test_workbook_of_all_sheets(spark, tmp_path, monkeypatch):
    rows = M._rows(spark, DATA)
    sheets = R.sheets(rows, table(spark, DATA, "files"), M.SPEC, M._UNKNOWN)
    none = spark.createDataFrame([], "issue string, expected double, actual double")
    sinks.write_workbook(sheets, none, str(tmp_path / "all.xlsx"))
    with zipfile.ZipFile(tmp_path / "all.xlsx") as z:
        assert re.findall(r'sheet name="([^"]*)"', z.read("xl/workbook.xml").decode()) == list(map(lambda n: n.replace("&", "&amp;"), sheets))
        first = z.read("xl/worksheets/sheet1.xml").decode()
        total = int(rows.agg(F.sum("qty")).first()[0])
        assert first.rindex("Grand Total") > first.rindex("Ready" if "Ready" in first else "Review required") and f"<v>{total}</v>" in first[first.rindex("Grand Total") :]
    monkeypatch.setattr(sinks, "MOST_ROWS", 3)
    with pytest.raises(sinks.TooLong):
        sinks.write_csv(sheets["Detail"], none, str(tmp_path / "long.csv"))
    assert not (tmp_path / "long.csv").exists()


def test_report_order(spark):
    shown = R.takeoff_lines(M._model(spark, DATA), R.line_sources(M._rows(spark, DATA), M.SPEC), M.SPEC).collect()
    groups = [r.category for r in shown]
    assert groups[-1] == "Grand Total" and [g for i, g in enumerate(groups) if i == 0 or groups[i - 1] != g] == list(dict.fromkeys(groups))
    amps = [float(r.rating) for r in shown if r.category == "MCBs" and r.rating != "Not specified"]
    assert amps == sorted(amps)
    purposes = [r.applications.split(", ") for r in shown[:-1]]
    assert all(p == sorted(p, key=R.PURPOSE_ORDER.index) for p in purposes)


def test_written_steps_leave_the_session_as_it_was(spark):
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before, where = spark.conf.get(key), spark.conf.get("spark.checkpoint.dir", None)
    with runtime.scratch(spark):
        df = runtime.materialise(spark.range(10).repartition(4), "test", by_size=True)
        assert df.count() == 10 and spark.conf.get(key) == before and spark.conf.get("spark.checkpoint.dir", None) == where
        path = df._tallyforge_path
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
