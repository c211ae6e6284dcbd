from pyspark.sql import functions as F

from tallyforge.functions import refs

CASES = [
    ("ＤＢ－０１", "DB-01", "DB01"), ("DB​-01 ", "DB-01", "DB01"), ("D­B–01", "DB-01", "DB01"), ("ЩO-01", "ЩО-01", "ЩО01"), ("DВ-01", "DB-01", "DB01"), ("ΤХ-01", "TX-01", "TX01"),
    ("CAFÉ-1", "CAFÉ-1", "CAFÉ1"), ("CAFЕ́-1", "CAFÉ-1", "CAFÉ1"), ("𝖳𝖷 𝟢𝟣", "TX 01", "TX01"), ("db_01/a.b", "db_01/a.b", "DB01AB"), ("ΔΡ-1", "ΔΡ-1", "ΔΡ1"), ("ΔP-1", "ΔΡ-1", "ΔΡ1"),
    (None, None, None), ("", "", None), ("  ", "", None), ("-", "-", None), ("TBC", "TBC", None), ("N/A", "N/A", None), ("/", "/", "/"), ("O0I1", "O0I1", "O0I1"),
]


def test_forms_and_keys(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, r string")
    got = {r.i: (r.f, r.k) for r in df.select("i", refs.consistent_form(F.col("r")).alias("f"), refs.board_key(F.col("r")).alias("k")).collect()}
    for i, (raw, form, key) in enumerate(CASES):
        assert got[i] == (form, key), raw
