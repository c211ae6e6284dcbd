"""Queries of lookups, routing, checks of completeness and roll-ups over the schedule tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions import normalise as N
from tallyforge.operators import coverage
from tallyforge.plans import report as R
from tallyforge.plans.sqltext import READINGS, q, t
from tallyforge.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return R.with_board(R.included(R.readings(table(spark, d, "devices"))))


def _norm(c: str) -> str:
    return f"regexp_replace(upper({t(c)}), '[\\s._/-]+', '', 'g')"


@query(
    """SELECT p.file_id, p.page, CASE WHEN page_type IN ('db-schedule', 'main-schedule', 'cable-schedule', 'equipment-schedule') THEN 'schedule' WHEN page_type IN ('sld', 'schematic') THEN 'schematic'
      WHEN page_type = 'unknown' THEN 'unknown' ELSE 'no rows' END AS reason FROM schedule_pages p LEFT JOIN (SELECT file_id, page, count(*) AS n FROM devices GROUP BY ALL) d ON d.file_id = p.file_id AND d.page = p.page
    WHERE page_type IN ('db-schedule', 'main-schedule', 'cable-schedule', 'equipment-schedule', 'sld', 'schematic', 'unknown') OR coalesce(n, 0) = 0"""
)
def page_routing(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a second extraction should read, with the first reason."""
    counts = table(spark, d, "devices").groupBy("file_id", "page").agg(F.count("*").alias("n"))
    kind = F.col("page_type")
    schedule, scheme = kind.isin("db-schedule", "main-schedule", "cable-schedule", "equipment-schedule"), kind.isin("sld", "schematic")
    pages = table(spark, d, "schedule_pages").join(counts, ["file_id", "page"], "left")
    reason = F.when(schedule, "schedule").when(scheme, "schematic").when(kind == "unknown", "unknown").when(F.coalesce("n", F.lit(0)) == 0, "no rows")
    return pages.select("file_id", "page", reason.alias("reason")).where("reason IS NOT NULL")


@query("SELECT board_id, coalesce(nullif(trim(f.file_name), ''), b.file_id, 'Not specified') AS document FROM boards b LEFT JOIN files f USING (file_id)")
def board_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document of each board row by name, else by id."""
    files = table(spark, d, "files").select("file_id", F.nullif(F.trim("file_name"), F.lit("")).alias("name"))
    return table(spark, d, "boards").join(files, "file_id", "left").select("board_id", F.coalesce("name", "file_id", F.lit("Not specified")).alias("document"))


@query(f"SELECT DISTINCT project_id, {_norm('to_ref')} AS board FROM feeds f WHERE {_norm('to_ref')} != '' AND NOT EXISTS (SELECT 1 FROM boards b WHERE b.project_id = f.project_id AND {_norm('b.ref')} = {_norm('f.to_ref')})")
def expected_not_found(spark: SparkSession, d: str) -> DataFrame:
    """Boards that feeds name and no schedule has."""
    wanted = table(spark, d, "feeds").select("project_id", N.norm_board(F.col("to_ref")).alias("board")).where("board != ''").distinct()
    return wanted.join(table(spark, d, "boards").select("project_id", N.norm_board(F.col("ref")).alias("board")), ["project_id", "board"], "left_anti")


@query(
    f"""WITH {READINGS} SELECT page_type, count(*) AS n_rows, count(DISTINCT board_id) AS n_boards, count(DISTINCT CASE WHEN way IS NOT NULL THEN board_id || '#' || way END) AS way_slots, count(*) FILTER (rating IS NULL) AS no_rating
    FROM included i JOIN schedule_pages s ON i.file_id = s.file_id AND i.page = s.page GROUP BY 1"""
)
def capture_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rows, boards and way slots captured by page type."""
    pages = table(spark, d, "schedule_pages").select("file_id", "page", "page_type")
    slot = F.when(F.col("way").isNotNull(), F.concat_ws("#", "board_id", "way"))
    return _rows(spark, d).join(pages, ["file_id", "page"]).groupBy("page_type").agg(
        F.count("*").alias("n_rows"), F.count_distinct("board_id").alias("n_boards"), F.count_distinct(slot).alias("way_slots"), F.count(F.when(F.col("rating").isNull(), 1)).alias("no_rating")
    )


@query(
    f"""WITH b AS (SELECT DISTINCT project_id, {_norm('ref')} AS board, regexp_matches(regexp_replace({t('ref')}, '[\\s._/\\\\-]+', '', 'g'), {q(coverage.UPSTREAM_REF)}, 'i') AS up FROM boards)
    SELECT project_id, count(*) FILTER (NOT up) AS in_scope, count(*) FILTER (up) AS upstream FROM b GROUP BY 1"""
)
def board_scope(spark: SparkSession, d: str) -> DataFrame:
    """Boards that are expected to show ways, and those upstream of them, by project."""
    ref = N.text(F.col("ref"))
    boards = table(spark, d, "boards").select("project_id", N.norm_board(F.col("ref")).alias("board"), coverage.in_scope(ref).alias("scope")).distinct()
    return boards.groupBy("project_id").agg(F.count(F.when(F.col("scope"), 1)).alias("in_scope"), F.count(F.when(~F.col("scope"), 1)).alias("upstream"))


@query(
    f"""WITH {READINGS}, active AS (SELECT DISTINCT file_id, page FROM included)
    SELECT s.page_type, count(*) AS n_pages FROM schedule_pages s SEMI JOIN active a ON a.file_id = s.file_id AND a.page = s.page WHERE s.text IS NULL GROUP BY 1"""
)
def active_unread_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without text that have rows that count, by type."""
    active = _rows(spark, d).select("file_id", "page")
    return table(spark, d, "schedule_pages").where("text IS NULL").join(active, ["file_id", "page"], "left_semi").groupBy("page_type").agg(F.count("*").alias("n_pages"))


@query(
    f"""WITH n AS (SELECT DISTINCT project_id, {_norm('ref')} AS board FROM boards WHERE {_norm('ref')} != ''), s AS (SELECT *, regexp_replace(replace(replace(board, 'O', '0'), 'I', '1'), '(LP|L|P)$', '') AS shape FROM n)
    SELECT project_id, shape, count(*) AS n_boards, array_to_string(list_sort(list(board)), ', ') AS boards FROM s GROUP BY 1, 2 HAVING count(*) > 1"""
)
def possible_duplicate_boards(spark: SparkSession, d: str) -> DataFrame:
    """Boards of a project whose refs differ in look-alike digits or the section only."""
    names = table(spark, d, "boards").select("project_id", N.norm_board(F.col("ref")).alias("board")).where("board != ''").distinct()
    shape = F.regexp_replace(F.translate("board", "OI", "01"), "(LP|L|P)$", "")
    listed = F.array_join(F.array_sort(F.collect_list("board")), ", ")
    return names.groupBy("project_id", shape.alias("shape")).agg(F.count("*").alias("n_boards"), listed.alias("boards")).where("n_boards > 1")


@query(
    f"""WITH {READINGS} SELECT project_id, sum(CASE WHEN upper(device) = 'SPARE' THEN 1 ELSE 0 END)::BIGINT AS spares, sum(CASE WHEN space THEN 1 ELSE 0 END)::BIGINT AS spaces, sum(CASE WHEN incomer THEN 1 ELSE 0 END)::BIGINT AS incomers, count(*) AS n_rows FROM readings GROUP BY 1"""
)
def capacity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Spares, blank ways and incomers by project: capacity, not devices to count."""
    one = lambda rule: F.sum(F.when(rule, 1).otherwise(0)).cast("bigint")
    return R.readings(table(spark, d, "devices")).groupBy("project_id").agg(
        one(F.upper("device") == "SPARE").alias("spares"), one(F.col("space")).alias("spaces"), one(F.col("incomer")).alias("incomers"), F.count("*").alias("n_rows")
    )


@query(
    """SELECT page_type, count(*) FILTER (text IS NOT NULL AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\d{1,3}\\s*[/ ]\\s*L[123]\\b|^\\s*(?:way|cct|ckt|circuit)\\s*\\d{1,3}\\b|^\\s*(?:\\d{1,3}\\s+)?L[123]\\b', 'i'))) >= 4) AS tabular,
      count(*) AS n_pages FROM schedule_pages GROUP BY 1"""
)
def tabular_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose lines start like rows, by type."""
    return table(spark, d, "schedule_pages").groupBy("page_type").agg(F.count(F.when(detect.looks_tabular(F.col("text")), 1)).alias("tabular"), F.count("*").alias("n_pages"))
