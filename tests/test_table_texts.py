import duckdb

from tallyforge.plans import parse_queries as Q

DATA = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.connect().execute(sql).fetchall()


def test_curves_of_a_fixture(spark, tmp_path):
    texts = [("MCB type C", "fan"), ("RCBO C curve 30 mA", "MCB B16, 10 kA"), ("MCB", None), (None, "Board C12 rev"), ("MCB curve: d", "")]
    spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "rec_id long, device_class string, description string").write.parquet(f"{tmp_path}/devices.parquet")
    got = sorted(tuple(r) for r in Q.device_curves(spark, str(tmp_path)).collect())
    assert got == [(0, "device_class", "C", None), (1, "description", "B", 10.0), (1, "device_class", "C", None), (4, "device_class", "D", None)]


def test_curves_of_every_device(spark):
    """A curve is named in words everywhere in the table; these forms by DuckDB."""
    field = lambda c: f"SELECT rec_id, '{c}' AS f, regexp_replace(coalesce({c}, ''), '[\\s   　]+', ' ', 'g') AS x FROM read_parquet('{DATA}/devices.parquet')"
    word = "coalesce(nullif(regexp_extract(x, '\\b(?:type|curve|characteristic)\\s*[-:]?\\s*([BCDKZ])\\b', 1, 'i'), ''), nullif(regexp_extract(x, '\\b([BCDKZ])\\s*[- ]?curve\\b', 1, 'i'), ''))"
    want = rows(f"SELECT rec_id, f, upper({word}) FROM ({field('device_class')} UNION ALL {field('description')}) WHERE {word} IS NOT NULL")
    got = [(r.rec_id, r.field_name, r.curve) for r in Q.device_curves(spark, DATA).where("curve IS NOT NULL").collect()]
    assert len(want) > 10 and sorted(got) == sorted(want)


def test_refs_of_a_fixture(spark, tmp_path):
    head = "DISTRIBUTION BOARD SCHEDULE\n"
    texts = [
        head + "Board Reference MSB-AA00-O1-02\nWay Phase", head + "Board Reference DB-GALERÍA-756 (continued)", head + "Board Reference ЩАО-01-98", head + "Board Reference ＤＢ－０１－２",
        head + "Board Reference PB 05.349 (continued)", "DB-00-SUBEXT next to SMDB-2A\nSMDB-2A", "Board Reference DB-01 fed from MSB1", "no board here", "Board Reference TBC", None,
    ]
    spark.createDataFrame([("f", i, x) for i, x in enumerate(texts)], "file_id string, page int, text string").write.parquet(f"{tmp_path}/schedule_pages.parquet")
    got = sorted((r.page, r.key) for r in Q.page_board_refs(spark, str(tmp_path)).collect())
    want = [(0, "MSBAA00O102"), (1, "DBGALERÍA756"), (2, "ЩАО0198"), (3, "DB012"), (4, "PB05349"), (5, "DB00SUBEXT"), (5, "SMDB2A"), (6, "DB01"), (6, "MSB1")]
    assert got == want


def test_refs_of_every_page(spark):
    want = rows(f"SELECT count(*) FROM read_parquet('{DATA}/schedule_pages.parquet') WHERE text LIKE '%Board Reference%'")[0][0]
    got = Q.page_board_refs(spark, DATA)
    assert want > 10 and got.select("file_id", "page").distinct().count() == want
