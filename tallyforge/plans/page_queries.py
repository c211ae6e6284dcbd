"""Queries of merging readings, of words and lines on pages, and of the longer report sheets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import detect, quality
from tallyforge.functions import normalise as N
from tallyforge.operators import crosscheck, spatial
from tallyforge.plans import report as R
from tallyforge.plans.rendered import EQUIPPED, with_equipment
from tallyforge.plans.sqltext import READINGS
from tallyforge.plans.takeoff_queries import _CONFS, _NORM, _RANKED
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


# --- merging boards ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH b AS (SELECT board_id, project_id, {_NORM('ref')} AS board, {_NORM('fed_from_ref')} AS parent, {_CONFS} AS conf, b.file_id, b.page, page_type = 'db-schedule' AS base FROM boards b JOIN schedule_pages s ON s.file_id = b.file_id AND s.page = b.page),
    k AS (SELECT * FROM b WHERE board != ''), p AS (SELECT * FROM k WHERE parent NOT IN ('', 'TBC', 'NA') AND parent != board),
    pages AS (SELECT project_id, board, count(DISTINCT (file_id, page)) AS n_pages, bool_or(base) AS known FROM k GROUP BY 1, 2),
    own AS (SELECT project_id, board, arg_max(parent, (conf, -board_id)) AS parent, max(conf) AS conf FROM p WHERE base GROUP BY 1, 2), new AS (SELECT project_id, board, arg_min(parent, board_id) AS parent FROM p WHERE NOT base GROUP BY 1, 2)
    SELECT g.project_id, g.board, n_pages, CASE WHEN n.parent IS NOT NULL AND 0.75 > coalesce(o.conf, 0) THEN n.parent ELSE o.parent END AS parent, round(CASE WHEN n.parent IS NOT NULL AND 0.75 > coalesce(o.conf, 0) THEN 0.75 ELSE coalesce(o.conf, 0) END, 6)::DOUBLE AS conf, NOT known AS added
    FROM pages g LEFT JOIN own o ON o.project_id = g.project_id AND o.board = g.board LEFT JOIN new n ON n.project_id = g.project_id AND n.board = g.board"""
)
def merge_boards(spark: SparkSession, d: str) -> DataFrame:
    """Boards of schedule pages with those of all other pages: pages are united, parents of the others count 0.75."""
    pages = table(spark, d, "schedule_pages").select("file_id", "page", (F.col("page_type") == "db-schedule").alias("base"))
    rows = table(spark, d, "boards").join(pages, ["file_id", "page"]).select(
        "board_id", "project_id", N.norm_board(F.col("ref")).alias("board"), N.norm_board(F.col("fed_from_ref")).alias("parent"), R.confidence(F.col("confidence")).alias("conf"), "file_id", "page", "base",
    )
    rows = rows.where("board != ''").withColumn("parent", F.when(~F.col("parent").isin("", "TBC", "NA") & (F.col("parent") != F.col("board")), F.col("parent")))
    return crosscheck.merge_boards(rows.where("base"), rows.where("NOT base"), ["project_id", "board"], "board_id").withColumn("conf", F.round("conf", 6))


@query(
    f"""WITH fp AS (SELECT DISTINCT project_id, {_NORM('to_ref')} AS board, {_NORM('from_ref')} AS parent, {_CONFS} AS conf, feed_id FROM feeds), known AS (SELECT DISTINCT project_id, {_NORM('ref')} AS board FROM boards)
    SELECT project_id, board, arg_max(parent, (conf, -feed_id)) AS parent, round(max(conf), 6) AS score FROM fp SEMI JOIN known USING (project_id, board) WHERE parent != '' AND board != '' AND parent != board GROUP BY 1, 2"""
)
def best_known_parent(spark: SparkSession, d: str) -> DataFrame:
    """The surest feed of each board that the board table has."""
    known = table(spark, d, "boards").select("project_id", N.norm_board(F.col("ref")).alias("board")).distinct()
    feeds = table(spark, d, "feeds").select("project_id", N.norm_board(F.col("to_ref")).alias("board"), N.norm_board(F.col("from_ref")).alias("parent"), R.confidence(F.col("confidence")).alias("conf"), "feed_id")
    feeds = feeds.where("parent != '' AND board != '' AND parent != board").join(known, ["project_id", "board"], "left_semi")
    best = F.max_by(F.struct("parent", F.round("conf", 6).alias("score")), F.struct("conf", -F.col("feed_id")))
    return feeds.groupBy("project_id", "board").agg(best.alias("b")).select("project_id", "board", "b.parent", "b.score")


@query(f"WITH {READINGS} SELECT board_id, min(rec_id) AS first_rec, row_number() OVER (ORDER BY min(rec_id))::INTEGER AS place FROM included GROUP BY 1")
def boards_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Boards in the order in which rows name them; places are counted over ranges of the first row, then over their totals."""
    firsts = _rows(spark, d).groupBy("board_id").agg(F.min("rec_id").alias("first_rec"))
    return crosscheck.placed(firsts, "first_rec").select("board_id", "first_rec", "place")


@query(f"WITH {READINGS} SELECT rec_id FROM readings WHERE NOT regexp_matches(description, '\\bas existing\\b|\\bby others\\b|\\btbc\\b', 'i') AND NOT (upper(device) IN ('SPARE', 'SPACE', 'BLANK') AND rating IS NULL)")
def populated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows without ignored words that are no unpopulated spare or blank way."""
    rows = R.readings(table(spark, d, "devices"))
    ignored = detect.has(F.col("description"), r"\bas existing\b|\bby others\b|\btbc\b")
    return rows.where(~ignored & ~(F.upper("device").isin("SPARE", "SPACE", "BLANK") & F.col("rating").isNull())).select("rec_id")


# --- words, lines and readings of pages -------------------------------------------------------------------------------

_WORDS = """words AS (SELECT file_id, page, line, string_split(t, ' ') AS ws FROM (SELECT file_id, page, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM schedule_pages WHERE text IS NOT NULL))"""


@query(
    f"""WITH {_WORDS}, x AS (SELECT file_id, page, line, list_filter(ws, lambda w: w != '') AS ws FROM words) SELECT file_id, page, (row_number() OVER (PARTITION BY file_id, page ORDER BY line) - 1)::INTEGER AS row_no, array_to_string(ws, ' ') AS text,
      len(ws)::INTEGER AS n_words, (line * 10.0)::DOUBLE AS y0, (line * 10.0 + 6.0)::DOUBLE AS y1 FROM x WHERE len(ws) > 0"""
)
def extent_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together by their extent from words of uneven height, with boxes in the scale of the page."""
    pages = table(spark, d, "schedule_pages").where("text IS NOT NULL")
    lines = pages.select("file_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("file_id", "page", "line", F.posexplode(F.split("t", " ")).alias("k", "text")).where("text != ''")
    top, x = F.col("line") * 20.0, F.col("k") * 60.0
    first = F.row_number().over(Window.partitionBy("file_id", "page", "line").orderBy("k")) == 1
    boxed = words.withColumn("f", first).select("file_id", "page", "text", x.alias("x0"), F.when(F.col("f"), top).otherwise(top + 2).alias("y0"), (x + 50).alias("x1"), (top + 12).alias("y1"), F.lit(90.0).alias("confidence"))
    return spatial.rows(boxed, ["file_id", "page"], 5.0, True, 0.5, 0.5).select("file_id", "page", "row_no", "text", "n_words", "y0", "y1")


_ORDERED = """o AS (SELECT file_id, page, rec_id, coalesce(way, 0) * 10.0 AS y0 FROM readings),
  e AS (SELECT file_id, page, coalesce(lag(y0) OVER (PARTITION BY file_id, page ORDER BY rec_id) - y0 > 8, false) AS above FROM o)"""


@query(f"WITH {READINGS}, {_ORDERED} SELECT file_id, page, count(*) FILTER (above) AS errors, greatest(1, count(*) - 1) AS pairs FROM e GROUP BY 1, 2")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand above the line read before them, on pages where each device's line stands at its way."""
    rows = R.readings(table(spark, d, "devices")).select("file_id", "page", "rec_id", (F.coalesce("way", F.lit(0)) * 10.0).alias("y0"))
    return spatial.order_errors(rows.withColumn("y1", F.col("y0") + 8), ["file_id", "page"], "rec_id")


@query(
    f"""WITH {READINGS}, {_ORDERED}, c AS (SELECT file_id, page, count(*) FILTER (above) AS errors, greatest(1, count(*) - 1) AS pairs FROM e GROUP BY 1, 2)
    SELECT file_id, page, CASE WHEN errors / pairs::DOUBLE > 0.12 THEN 'ocr' ELSE 'embedded_text' END AS route FROM c"""
)
def routes_by_order(spark: SparkSession, d: str) -> DataFrame:
    """How pages are read whose text is good, by the order of their lines alone."""
    counted = reading_order(spark, d)
    text = F.repeat(F.lit("Way 1 L1 16A MCB type C 10kA\n"), 40)
    read = quality.page_quality(text, F.lit(None).cast("string"), F.col("errors"), F.col("pairs") + 1)
    return counted.select("file_id", "page", read["route"].alias("route"))


@query(
    """WITH p AS (SELECT file_id, page, width, height, (page % 5) * 90 AS turn, (page % 3) * 0.4 AS skew, 0.1 + (page % 4) * 0.1 AS contrast, (page % 6) * 0.05 AS noise, page % 7 = 0 AS uneven, CASE WHEN page % 2 = 0 THEN 8.0 ELSE 12.0 END AS letter FROM schedule_pages),
    r AS (SELECT *, CASE WHEN turn IN (90, 180, 270) THEN turn ELSE 0 END AS rot, letter < 9 OR least(width, height) < 800 AS low, contrast < 0.19 OR uneven OR noise > 0.21 AS poor FROM p)
    SELECT file_id, page, unnest(list_filter(['base', 'enhanced', CASE WHEN rot != 0 THEN 'rotate-' || rot END, CASE WHEN skew >= 0.35 THEN 'deskew' END, CASE WHEN poor THEN 'adaptive-threshold' END, CASE WHEN low THEN 'upscaled' END], lambda x: x IS NOT NULL)) AS id FROM r"""
)
def reading_plans(spark: SparkSession, d: str) -> DataFrame:
    """Ways to render each page again, by turn, skew, contrast, noise and height of letters that follow from its number."""
    n = F.col("page")
    plan = quality.reading_plan(
        F.col("width"), F.col("height"), F.when(n % 2 == 0, 8.0).otherwise(12.0), (n % 5) * 90, (n % 3) * 0.4, F.when(n % 4 == 0, 0.1).otherwise(0.3), (n % 6) * 0.05, n % 7 == 0
    )
    return table(spark, d, "schedule_pages").select("file_id", "page", F.explode(plan).alias("c")).select("file_id", "page", "c.id")


# --- sheets --------------------------------------------------------------------------------------------------------------

@query(f"WITH {READINGS}, {EQUIPPED} SELECT rec_id, named AS device, n AS qty FROM equipped")
def associated_equipment(spark: SparkSession, d: str) -> DataFrame:
    """Control equipment that descriptions name, by row."""
    return R.equipment(with_equipment(_rows(spark, d))).select("rec_id", "device", "qty")


@query(f"WITH {READINGS}, {EQUIPPED} SELECT named AS device, count(*) AS n_rows, sum(n) AS quantity, round(least(1.0, min(conf)), 6)::DOUBLE AS confidence FROM equipped GROUP BY 1")
def equipment_totals(spark: SparkSession, d: str) -> DataFrame:
    """Control equipment that descriptions name, in all."""
    return R.equipment_model(with_equipment(_rows(spark, d))).select("device", "n_rows", "quantity", "confidence")


@query(f"WITH {READINGS}, {EQUIPPED} SELECT named AS device, board_id, grouping(named, board_id)::BIGINT AS level, sum(n) AS quantity, round(least(1.0, min(conf)), 6)::DOUBLE AS confidence FROM equipped GROUP BY ROLLUP (named, board_id)")
def equipment_by_board(spark: SparkSession, d: str) -> DataFrame:
    """Control equipment that descriptions name, by board, in all, and altogether."""
    named = R.equipment(with_equipment(_rows(spark, d))).select("device", "board_id", "qty", "conf")
    return named.rollup("device", "board_id").agg(F.grouping_id().cast("bigint").alias("level"), F.sum("qty").alias("quantity"), F.round(F.least(F.lit(1.0), F.min("conf")), 6).alias("confidence"))


@query(
    f"""WITH {READINGS}, {EQUIPPED}, u AS (SELECT rec_id, board_id, device, grp AS category, qty::DOUBLE AS qty, false AS associated FROM included UNION ALL SELECT rec_id, board_id, named, 'Control & associated equipment', n, true FROM equipped)
    SELECT u.rec_id, u.board_id, u.category, u.device, u.qty, associated, i.purpose, CASE WHEN incomer THEN 'Incomer' ELSE 'Outgoing' END AS role, coalesce(i.way::VARCHAR, 'Not specified') AS circuit,
      coalesce(nullif(i.description || CASE i.rec_id % 4 WHEN 0 THEN ' with ' || (i.rec_id % 9 + 1) || ' x contactors' WHEN 1 THEN ' and time clock' WHEN 2 THEN ' via ' || (i.rec_id % 9 + 1) || ' x photocells' ELSE '' END, ''), 'Not specified') AS description,
      coalesce(nullif(trim(f.file_name), ''), i.file_id, 'Not specified') AS document, i.page FROM u JOIN included i USING (rec_id) LEFT JOIN files f ON f.file_id = i.file_id"""
)
def detail_with_equipment(spark: SparkSession, d: str) -> DataFrame:
    """Every row that counts and the equipment it names, with circuit, role, description and document."""
    return R.full_detail(with_equipment(_rows(spark, d)), table(spark, d, "files"))


@query(
    f"""WITH {READINGS}, {_RANKED} SELECT rec_id AS record, retained, board_id, 'Duplicate record' AS field, 'Excluded; the surest reading is kept' AS action FROM ranked WHERE rk > 1
    UNION ALL SELECT rec_id, NULL, board_id, 'Confidence', 'Confirm against the source' FROM ranked WHERE rk = 1 AND conf < 0.8
    UNION ALL SELECT rec_id, NULL, board_id, 'Current rating', 'Confirm against the source' FROM ranked WHERE rk = 1 AND rating IS NULL"""
)
def review_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that need a look: unsure ones, those without a rating, and repeated ones with the record kept instead."""
    return R.review_records(_rows(spark, d), ["project_id", "board", "way", "phase", *R.SPEC])
