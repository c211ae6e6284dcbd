import re
import unicodedata

import duckdb
import pytest

from tallyforge.plans import takeoff_queries as Q

DATA = "/root/testdata/sf0.001"
SCHEMA = "rec_id long, project_id string, file_id string, page int, board_ref string, way string, phase string, device_class string, rating_a string, trip_curve string, poles string, description string, confidence string, is_incomer boolean, received_at timestamp"


def write(spark, path, refs):
    rows = [(i, "P", "f", 1, r, "1", "L1", "MCB", "16", "C", "SP", "", "1", False, None) for i, r in enumerate(refs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/devices.parquet")


@pytest.mark.parametrize("refs, boards, keys", [
    (["DB-10", "DB-9", None, " ", "-"], ["DB9", "DB10"], ["db000000000009", "db000000000010"]),
    (["PDB-CAFÉ-10", "PDB-CAFE-9", "PDB-CAFÉ-11"], ["PDBCAFE9", "PDBCAFÉ10", "PDBCAFÉ11"], ["pdbcafe000000000009", "pdbcafe000000000010", "pdbcafe000000000011"]),
    (["ЩР-10", "ЩР-9"], ["ЩР9", "ЩР10"], ["щр000000000009", "щр000000000010"]),
    (["DB-12345678901234567890", "DB-999999999999", "DB-0009", "DB-09"], ["DB0009", "DB09", "DB999999999999", "DB12345678901234567890"],
     ["db000000000009", "db000000000009", "db999999999999", "db:00002012345678901234567890"]),
    (["DB-１０", "DB-9"], ["DB9", "DB１０"], ["db000000000009", "db000000000010"]),
])
def test_every_board_by_value(spark, tmp_path, refs, boards, keys):
    write(spark, tmp_path, refs)
    got = Q.natural_order(spark, str(tmp_path)).collect()
    assert [r.board for r in got] == boards
    assert [r.key for r in got] == keys


def test_no_board_is_lost(spark):
    rows = Q._rows(spark, DATA).select("board").where("board != ''").collect()
    got = [(r.board, r.key) for r in Q.natural_order(spark, DATA).collect()]
    assert len(got) == len(set(got)) and {b for b, _ in got} == {r.board for r in rows}
    assert got == sorted(got, key=lambda x: (x[1].encode(), x[0].encode()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW devices AS SELECT * FROM read_parquet('{DATA}/devices.parquet')")
    assert set(con.execute(Q.SQL["natural_order"]).fetchall()) == set(got)


def test_keys_of_latin_boards_by_brute_force(spark):
    def key(board):
        plain = "".join(c for c in unicodedata.normalize("NFKD", board) if unicodedata.category(c) not in ("Mn", "Cf")).lower()
        return re.sub(r"[0-9]+", lambda m: m[0].zfill(12)[:12], plain)

    got = {r.board: r.key for r in Q.natural_order(spark, DATA).collect()}
    plain = {b: k for b, k in got.items() if re.fullmatch(r"[A-Za-z0-9À-ÿ]+", b)}
    assert any(not b.isascii() for b in plain)
    assert plain == {b: key(b) for b in plain}
