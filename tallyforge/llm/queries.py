"""Queries of the operators in this package over the test tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import refs as R
from tallyforge.llm import canonical, mixing, splitting, survivors, textform, tokens
from tallyforge.llm.vocabulary import ALIASES
from tallyforge.plans.record_queries import sql_keys
from tallyforge.runtime import materialise, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "device_terms").select(F.col("field_name").alias("field"), F.col("term_id").cast("bigint").alias("term"), "label")
    return canonical.match(table(spark, d, "devices"), "rec_id", ["device_class", "description"], terms, ALIASES)


def p2_misses(spark: SparkSession, d: str) -> DataFrame:
    """Values per field that an entry fits and that none fits."""
    return p2_found(spark, d).groupBy("field_name").agg(F.count("*").alias("n_values"), F.count(F.when(F.col("term_id") == 0, 1)).alias("n_misses"))


# --- surviving readings of circuits ---------------------------------------------------------------------------------

_WAY = r"^\s*(?i:way|w|cct|ckt|circuit)?[\s.:#]*0*([0-9]{1,9})(?:[.,]0+)?\s*$"
_NUMBER = r"^\s*([0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)\s*(?i:a|amps?)?\s*$"
_CONFIDENCE = r"^\s*([0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)\s*(%?)\s*$"


def way_number(way: Column) -> Column:
    return F.regexp_extract(way, _WAY, 1).try_cast("int")


def confidence_number(c: Column) -> Column:
    """Per cent as hundredths, a comma as point; 0 if it is no number."""
    n = F.replace(F.regexp_extract(c, _CONFIDENCE, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(F.when(F.regexp_extract(c, _CONFIDENCE, 2) == "%", n / 100).otherwise(n), F.lit(0.0))


def _circuits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "devices").withColumns(
        {"board_key": R.board_key(F.col("board_ref")), "way_no": way_number(F.col("way")), "phase_key": F.coalesce("phase", F.lit(""))}
    )
    rows = rows.where("board_key IS NOT NULL AND way_no IS NOT NULL")
    written = lambda c: F.col(c).rlike(r"(?U)\S")
    number = F.regexp_extract("rating_a", _NUMBER, 1)
    fields = {"rating_a": (number != "", F.replace(number, F.lit(","), F.lit(".")).try_cast("double"))}
    fields |= {c: (written(c), F.col(c)) for c in ("description", "device_class", "trip_curve", "poles", "rcd_ma", "cpc_csa_mm2")}
    return survivors.surviving(rows, ["project_id", "board_key", "way_no", "phase_key"], "rec_id", confidence_number(F.col("confidence")), "received_at", fields)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    best = _circuits(spark, d)
    cells = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(c).alias("rec_id")) for name, c in (("record", "record"), ("rating_a", "rating_a_from"), ("description", "description_from"))])
    return best.select(F.explode(cells).alias("c")).select("c.field_name", "c.rec_id").where("rec_id IS NOT NULL")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving row of each circuit."""
    return _circuits(spark, d).select("project_id", "board_key", "way_no", F.col("phase_key").alias("phase"), "n_rows", "record", "rating_a", "description", "device_class", "trip_curve", "poles", "rcd_ma", "cpc_csa_mm2")


# --- consistent forms -----------------------------------------------------------------------------------------------


def _raw_refs(spark: SparkSession, d: str) -> DataFrame:
    boards = table(spark, d, "boards").select(F.lit("boards").alias("src_table"), F.col("board_id").alias("record_id"), F.col("ref").alias("raw"))
    devices = table(spark, d, "devices").select(F.lit("devices").alias("src_table"), F.col("rec_id").alias("record_id"), F.col("board_ref").alias("raw"))
    return boards.unionByName(devices)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    forms = textform.consistent(_raw_refs(spark, d), "raw", "form", ["src_table", "record_id", "raw"])
    return forms.where(R.is_reference(F.col("form")) & (F.col("form") != F.col("raw"))).select("src_table", "record_id")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every ref in its consistent form."""
    return textform.consistent(_raw_refs(spark, d), "raw", "form", ["src_table", "record_id"])


# --- tokens -----------------------------------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "text", ["doc_id"])


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count(table(spark, d, "documents"), "text", ["doc_id", "source"])
    return materialise(sizes.withColumnRenamed("doc_id", "id"), "sizes")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))
    return mixed.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.ranges(table(spark, d, "documents"), "text", ["doc_id"]).where(F.size("ranges") > 1).select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), "text", ["doc_id"])


_DEVICE_KEYS = sql_keys("SELECT board_ref AS r FROM devices")
_ALL_KEYS = sql_keys("SELECT ref AS r FROM boards UNION ALL SELECT board_ref FROM devices")
_ROWS = f"""{_DEVICE_KEYS},
    rows AS (SELECT rec_id, project_id, key, coalesce(phase, '') AS phase, received_at, description, rating_a,
        try_cast(regexp_extract(way, '^\\s*(?i:way|w|cct|ckt|circuit)?[\\s.:#]*0*([0-9]{{1,9}})(?:[.,]0+)?\\s*$', 1) AS INTEGER) AS way_no,
        coalesce(CASE WHEN confidence LIKE '%\\%%' ESCAPE '\\' THEN n / 100 ELSE n END, 0) AS conf
      FROM (SELECT *, try_cast(replace(regexp_extract(confidence, '{_CONFIDENCE}', 1), ',', '.') AS DOUBLE) AS n FROM devices JOIN keys ON board_ref = r AND is_ref)),
    many AS (SELECT *, count(*) OVER c AS n_rows FROM rows WHERE way_no IS NOT NULL WINDOW c AS (PARTITION BY project_id, key, way_no, phase)),
    long AS (SELECT 'record' AS field_name, * FROM many WHERE n_rows > 1
      UNION ALL SELECT 'rating_a', * FROM many WHERE n_rows > 1 AND regexp_matches(rating_a, '{_NUMBER}')
      UNION ALL SELECT 'description', * FROM many WHERE n_rows > 1 AND trim(description) != '')"""

_TEXTS = ("description", "device_class", "trip_curve", "poles", "rcd_ma", "cpc_csa_mm2")
_BEST = "arg_max({0}, (conf, coalesce(received_at, TIMESTAMP '0001-01-01'), -rec_id))"
_SURVIVORS = f"""{_DEVICE_KEYS},
    rows AS (SELECT d.*, key, coalesce(phase, '') AS phase_key, try_cast(regexp_extract(way, '^\\s*(?i:way|w|cct|ckt|circuit)?[\\s.:#]*0*([0-9]{{1,9}})(?:[.,]0+)?\\s*$', 1) AS INTEGER) AS way_no,
        try_cast(replace(nullif(regexp_extract(rating_a, '{_NUMBER}', 1), ''), ',', '.') AS DOUBLE) AS amps, coalesce(CASE WHEN confidence LIKE '%\\%%' ESCAPE '\\' THEN n / 100 ELSE n END, 0) AS conf
      FROM (SELECT *, try_cast(replace(regexp_extract(confidence, '{_CONFIDENCE}', 1), ',', '.') AS DOUBLE) AS n FROM devices) d JOIN keys ON board_ref = r AND is_ref)"""

QUERIES = {
    "p2_found": p2_found, "p2_misses": p2_misses, "p4_found": p4_found, "p4_survivors": p4_survivors, "p5_found": p5_found, "p5_forms": p5_forms,
    "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_pieces": p8_pieces,
}
SQL = {
    "p4_found": f"""WITH {_ROWS} SELECT field_name, rec_id FROM long
      QUALIFY row_number() OVER (PARTITION BY field_name, project_id, key, way_no, phase ORDER BY conf DESC, received_at DESC, rec_id) = 1""",
    "p4_survivors": f"""WITH {_SURVIVORS} SELECT project_id, key AS board_key, way_no, phase_key AS phase, count(*) AS n_rows, {_BEST.format('rec_id')} AS record, {_BEST.format('amps')} FILTER (regexp_matches(rating_a, '{_NUMBER}')) AS rating_a,
      {', '.join(f"{_BEST.format(c)} FILTER (trim({c}) != '') AS {c}" for c in _TEXTS)} FROM rows WHERE way_no IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "p5_found": f"""WITH {_ALL_KEYS} SELECT 'boards' AS src_table, board_id AS record_id FROM boards JOIN keys ON ref = r WHERE is_ref AND form != r
      UNION ALL SELECT 'devices', rec_id FROM devices JOIN keys ON board_ref = r WHERE is_ref AND form != r""",
    "p5_forms": f"""WITH {_ALL_KEYS} SELECT 'boards' AS src_table, board_id AS record_id, form FROM boards LEFT JOIN keys ON ref = r
      UNION ALL SELECT 'devices', rec_id, form FROM devices LEFT JOIN keys ON board_ref = r""",
}
