import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.operators import consolidate as C
from tallyforge.operators import crosscheck, dedup, spatial
from tallyforge.plans import report as R
from tallyforge.sources import pages, sinks
from tallyforge.streaming import ingest

ROWS = [("b1", "MCB", 16.0, "B", "SPN", 1, 0.9), ("b2", "MCB", 16.0, "B", "SPN", 2, 0.7), ("b1", "MCB", 16.0, "C", "SPN", 1, 0.9), ("b1", "MCB", 16.0, "Not specified", "SPN", 4, 0.9), ("b1", "RCBO", None, "B", "Unclear", 1, 0.9)]
SCHEMA = "board_id string, device string, rating double, curve string, pole string, qty int, conf double"


def test_lines_conflicts_and_gate(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    lines = C.lines(rows, R.SPEC, "qty", "conf")
    assert {(r.device, r.curve): r.quantity for r in lines.collect()} == {("MCB", "B"): 3, ("MCB", "C"): 1, ("MCB", "Not specified"): 4, ("RCBO", "B"): 1}
    found = {(r.device, r.curve): r.conflicts for r in C.conflicts(lines, R.SPEC, {"curve": [N.NOT_SPECIFIED], "pole": [N.UNCLEAR]}).collect()}
    assert found == {("MCB", "B"): "curve", ("MCB", "C"): "curve", ("MCB", "Not specified"): "", ("RCBO", "B"): ""}
    totals = rows.groupBy("board_id").agg(F.sum("qty").alias("quantity"))
    assert C.gate(rows, lines, totals, "qty", R.SPEC).count() == 0
    tampered = C.gate(rows, lines.withColumn("quantity", F.col("quantity") - F.when(F.col("curve") == "C", 1).otherwise(0)), totals, "qty", R.SPEC)
    assert {r.issue for r in tampered.collect()} == {"line", "source and lines"}
    with pytest.raises(C.NotReconciled):
        sinks.write_csv(lines, tampered, str(tmp_path / "x.csv"))
    assert not (tmp_path / "x.csv").exists()
    sheet = R.takeoff_sheet(rows, ["b1", "b2", "b3"])
    assert {r.device: (r.b1, r.b2, r.b3, r.total) for r in sheet.where("curve IS NULL").collect()} == {None: (7, 2, None, 9)}
    sinks.write_csv(sheet.orderBy("total"), C.gate(rows, lines, totals, "qty", R.SPEC), str(tmp_path / "y.csv"))
    text = (tmp_path / "y.csv").read_bytes().decode()
    assert text.startswith("﻿device,") and text.count("\r\n") == 5 and not text.endswith("\n")
    sinks.write_workbook({"Take-Off": sheet, "Detail": rows}, C.gate(rows, lines, totals, "qty", R.SPEC), str(tmp_path / "y.xlsx"))
    with zipfile.ZipFile(tmp_path / "y.xlsx") as z:
        assert "RCBO" in z.read("xl/worksheets/sheet2.xml").decode()


def test_small_text_functions():
    assert [sinks.column_name(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert sinks.csv_cell('a "b", c') == '"a ""b"", c"' and sinks.csv_cell(None) == ""


def test_dedup_keeps_earliest_of_ties(spark):
    df = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 0.9), ("k", 3, 0.9), (None, 4, None), (None, 5, 0.1)], "k string, o int, s double")
    assert {r.o for r in dedup.keep_best(df, ["k"], F.col("s"), "o").collect()} == {2, 5}
    assert {(r.o, r.retained) for r in dedup.excluded(df, ["k"], F.col("s"), "o").collect()} == {(1, 2), (3, 2), (4, 5)}


def test_cross_check_and_changes(spark):
    s = "k string, way string, rating double, device string, o int"
    p = spark.createDataFrame([("a", "1", 32.0, "MCB", 1), ("b", None, 16.0, "spare", 2), ("c", "1", 6.0, "MCB", 3)], s)
    q = spark.createDataFrame([("a", "1", 40.0, "RCBO", 1), ("b", None, 16.0, "MCB", 2), ("d", "1", 6.0, "MCB", 3)], s)
    spare = (F.col("p.device") != "spare", F.col("s.device") != "spare")
    got = {(r.k, r.kind, r.field) for r in crosscheck.cross_check(p, q, ["k", "way"], {"rating": None, "device": spare}, "o").collect()}
    assert got == {("a", "field_mismatch", "rating"), ("a", "field_mismatch", "device"), ("c", "missing_in_second", None), ("d", "missing_in_primary", None)}
    assert {(r.k, r.change) for r in crosscheck.changes(p, q, ["k", "way"], ["rating"]).collect()} == {("a", "changed"), ("c", "removed"), ("d", "added")}


def test_spatial_rows_and_cells(spark):
    words = [("p", "Way", 10.0, 10.0, 40.0, 20.0, 90.0), ("p", "1", 50.0, 11.0, 60.0, 21.0, 80.0), ("p", "MCB", 10.0, 35.0, 40.0, 45.0, 90.0), ("p", "16A", 240.0, 35.0, 270.0, 45.0, None), ("p", " ", 1.0, 1.0, 2.0, 2.0, 1.0), ("p", "x", None, 1.0, 2.0, 2.0, 1.0)]
    df = spark.createDataFrame(words, "page string, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = spatial.rows(df, ["page"]).orderBy("row_no").collect()
    assert [(r.text, r.cells) for r in got] == [("Way 1", ["Way 1"]), ("MCB 16A", ["MCB", "16A"])]
    assert (got[1].x0, got[1].y0, got[1].x1, got[1].y1) == (10.0, 35.0, 270.0, 45.0)


def test_results_and_streams(spark, tmp_path):
    json = '{"devices": [{"board_ref": "DB1", "way": "18", "rating_a": "", "cpc_csa_mm2": "SWA", "is_spare": false}]}'
    df = pages.model_results(spark.createDataFrame([(1, json), (2, "{bad")], "id int, j string"), "j")
    got = pages.result_devices(df, ["id"]).collect()
    assert [(r.id, r.way, r.rating_a, r.cpc_raw, r.cpc_mm2) for r in got] == [(1, 18, None, "SWA", None)]
    rows = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "id int, d string").select("id", F.to_timestamp("d").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.once(ingest.arriving(spark, str(tmp_path / "in"), "id int, at timestamp"), ["id"], "at")
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_fingerprint(spark):
    s = "id int, b string, w int, ph string, f string, p int, box array<double>, line int, src string"
    df = spark.createDataFrame([(1, "DB1", 3, "L1", "f", 1, None, 1, "x"), (2, "DB1", 3, None, "f", 2, [1.0, 2.0], 9, "y"), (3, "", 3, "L1", "f", 1, [1.04, 2.0], 1, "x"), (4, None, None, None, None, None, None, None, None)], s)
    c = F.col
    got = [r[0] for r in df.orderBy("id").select(dedup.fingerprint(c("b"), c("w"), c("ph"), F.lit("MCB"), c("f"), c("p"), c("box"), c("line"), c("src"))).collect()]
    assert got == ["circuit|DB1|3|L1|MCB", "circuit|DB1|3||MCB", "region|f|1|1.0,2.0|MCB", "source||||"]
