"""Queries of the report, comparison and sequence operators over the schedule tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.functions.patterns import DIGITS, accents, natural_key
from tallyforge.functions.refs import consistent_form
from tallyforge.operators import consolidate as C
from tallyforge.operators import coverage, crosscheck, dedup, sequences
from tallyforge.plans import report as R
from tallyforge.plans.record_queries import sql_keys
from tallyforge.plans.sqltext import READINGS, got, q, t
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


_KEY = "device, rating, curve, pole"
_LINES = f"""lines AS (SELECT grp, {_KEY}, sum(qty)::BIGINT AS quantity, count(*) AS n_rows, round(least(1.0, min(conf)), 6)::DOUBLE AS confidence,
    array_to_string(list_sort(list(DISTINCT purpose)), '; ') AS purposes, count(DISTINCT board_id) AS n_boards FROM included GROUP BY grp, {_KEY}),
  reviewed AS (SELECT *, concat_ws('; ', CASE WHEN rating IS NULL THEN 'rating missing' END, CASE WHEN curve = 'Not specified' THEN 'curve not specified' END,
    CASE WHEN pole IN ('Unclear', 'Not specified') THEN 'pole configuration unclear' END, CASE WHEN confidence < 0.8 THEN 'low confidence' END) AS reasons,
    concat_ws(' ', CASE WHEN rating IS NULL THEN 'Not specified' ELSE regexp_replace(regexp_replace(printf('%.2f', rating), '0+$', ''), '\\.$', '') || 'A' END,
      CASE WHEN upper(device) IN ('MCB', 'RCBO', 'AFDD+RCBO', 'MCCB', 'ACB', 'RCD') THEN pole END, device) AS label FROM lines)"""


@query(f"WITH {READINGS} SELECT rec_id, board, way, phase, device, grp, rating, curve, pole, purpose, round(conf, 6) AS conf, qty FROM readings")
def device_readings(spark: SparkSession, d: str) -> DataFrame:
    """Normalised fields of every device row."""
    rows = R.readings(table(spark, d, "devices"))
    return rows.select("rec_id", "board", "way", "phase", "device", "grp", "rating", "curve", "pole", "purpose", F.round("conf", 6).alias("conf"), "qty")


@query(f"WITH {READINGS}, {_LINES} SELECT grp, {_KEY}, quantity, n_rows, confidence, purposes, n_boards, label, reasons FROM reviewed")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Lines of equal specification with quantity, least confidence, purposes, boards and review reasons."""
    return R.lines(_rows(spark, d)).drop("notes")


@query(
    f"WITH {READINGS} SELECT grp, "
    + ", ".join(f"nullif(sum(CASE WHEN purpose = {q(p)} THEN qty ELSE 0 END), 0)::BIGINT AS \"{p}\"" for p in R.PURPOSES)
    + ", sum(qty)::BIGINT AS total FROM included GROUP BY ROLLUP (grp)"
)
def quantity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of each group by purpose, and the grand total."""
    return C.matrix(_rows(spark, d), ["grp"], "purpose", R.PURPOSES, "qty")


@query(f"WITH {READINGS} SELECT project_id, board, grouping(project_id, board)::BIGINT AS level, sum(qty)::BIGINT AS quantity FROM included GROUP BY ROLLUP (project_id, board)")
def board_totals(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of every board, project and in all."""
    return C.totals(_rows(spark, d), ["project_id", "board"], "qty")


_RANKED = f"ranked AS (SELECT *, row_number() OVER w AS rk, first_value(rec_id) OVER w AS retained FROM included WINDOW w AS (PARTITION BY project_id, board, way, phase, {_KEY} ORDER BY conf DESC, rec_id))"


@query(f"WITH {READINGS}, {_RANKED} SELECT rec_id FROM ranked WHERE rk = 1")
def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """The surest reading of each circuit and specification."""
    return R.unique(_rows(spark, d)).select("rec_id")


@query(f"WITH {READINGS}, {_RANKED} SELECT rec_id, retained FROM ranked WHERE rk > 1")
def dedup_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Readings left out, each with the one kept instead."""
    keys = ["project_id", "board", "way", "phase", *R.SPEC]
    return dedup.excluded(_rows(spark, d), keys, F.col("conf"), "rec_id").select("rec_id", "retained")


@query(
    f"""WITH {READINGS}, lines AS (SELECT {_KEY}, sum(qty)::BIGINT AS quantity FROM included GROUP BY ALL),
    c AS (SELECT device, rating, pole FROM lines WHERE curve != 'Not specified' GROUP BY ALL HAVING count(DISTINCT curve) > 1),
    p AS (SELECT device, rating, curve FROM lines WHERE pole NOT IN ('Not specified', 'Unclear') GROUP BY ALL HAVING count(DISTINCT pole) > 1)
    SELECT l.*, concat_ws(', ', CASE WHEN l.curve != 'Not specified' AND EXISTS (SELECT 1 FROM c WHERE c.device = l.device AND c.rating IS NOT DISTINCT FROM l.rating AND c.pole = l.pole) THEN 'curve' END,
      CASE WHEN l.pole NOT IN ('Not specified', 'Unclear') AND EXISTS (SELECT 1 FROM p WHERE p.device = l.device AND p.rating IS NOT DISTINCT FROM l.rating AND p.curve = l.curve) THEN 'pole' END) AS conflicts FROM lines l"""
)
def spec_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Lines that agree with others in all but one attribute, of which both have known values."""
    lines = _rows(spark, d).groupBy(*R.SPEC).agg(F.sum("qty").alias("quantity"))
    return C.conflicts(lines, R.SPEC, {"curve": [N.NOT_SPECIFIED], "pole": [N.NOT_SPECIFIED, N.UNCLEAR]})


@query(
    f"""WITH {READINGS}, {_LINES}, s AS (SELECT label, curve, quantity, unnest(string_split(reasons, '; ')) AS reason FROM reviewed WHERE reasons != ''),
    f AS (SELECT *, CASE WHEN reason LIKE '%curve%' THEN 'Tripping curve' WHEN reason LIKE '%pole%' THEN 'Pole configuration' WHEN reason LIKE '%rating%' THEN 'Current rating' ELSE 'Source record' END AS field FROM s)
    SELECT *, 'Confirm ' || lower(field) AS action FROM f"""
)
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Review reasons, one a row."""
    return R.review_sheet(R.lines(_rows(spark, d)))


@query(
    f"""WITH {READINGS}, {_LINES} SELECT {q(R.NOTES['rating'])} AS note, count(*) AS n_lines, sum(quantity)::BIGINT AS quantity FROM lines WHERE rating IS NULL HAVING count(*) > 0
    UNION ALL SELECT {q(R.NOTES['curve'])}, count(*), sum(quantity)::BIGINT FROM lines WHERE curve = 'Not specified' HAVING count(*) > 0
    UNION ALL SELECT {q(R.NOTES['pole'])}, count(*), sum(quantity)::BIGINT FROM lines WHERE pole IN ('Unclear', 'Not specified') HAVING count(*) > 0
    UNION ALL SELECT 'Every total was reconciled before release.', 0, 0 UNION ALL SELECT 'No value has been assumed silently.', 0, 0"""
)
def qualification_rows(spark: SparkSession, d: str) -> DataFrame:
    """Qualifications with the lines and devices they are about."""
    return R.qualification_sheet(R.lines(_rows(spark, d)))


@query(
    f"""WITH {READINGS}, l AS (SELECT * FROM included) SELECT rec_id, project_id, board, way, phase, grp,
      concat_ws(' ', CASE WHEN rating IS NULL THEN 'Not specified' ELSE regexp_replace(regexp_replace(printf('%.2f', rating), '0+$', ''), '\\.$', '') || 'A' END,
      CASE WHEN upper(device) IN ('MCB', 'RCBO', 'AFDD+RCBO', 'MCCB', 'ACB', 'RCD') THEN pole END, device) AS label, purpose, qty, file_id, page FROM l"""
)
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row that counts."""
    return R.detail_sheet(_rows(spark, d))


@query(
    f"""WITH {READINGS}, cells AS (SELECT rec_id, 'device' AS field, device AS value FROM included UNION ALL
      SELECT rec_id, 'rating', CASE WHEN rating IS NOT NULL THEN regexp_replace(regexp_replace(printf('%.2f', rating), '0+$', ''), '\\.$', '') END FROM included
      UNION ALL SELECT rec_id, 'curve', curve FROM included UNION ALL SELECT rec_id, 'pole', pole FROM included)
    SELECT *, CASE WHEN value IS NULL OR value IN ('Not specified', 'Unclear', 'Other device') THEN 'Review required' ELSE 'Read from source' END AS status FROM cells"""
)
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Specification fields of every row with their status."""
    return R.audit_sheet(_rows(spark, d))


@query(
    f"""WITH {READINGS} SELECT device, coalesce(file_id, 'Not specified') AS document, 'p' || array_to_string(list_sort(list(DISTINCT page)), ', p') AS pages
    FROM included WHERE page IS NOT NULL GROUP BY 1, 2"""
)
def source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each document behind each device family."""
    return R.source_pages(_rows(spark, d), ["device"])


@query(
    f"""WITH {READINGS}, {_RANKED}, k AS (SELECT {_KEY}, sum(qty)::DOUBLE AS expected, sum(qty) FILTER (rk = 1)::DOUBLE AS actual FROM ranked GROUP BY ALL),
    s AS (SELECT sum(qty)::DOUBLE AS expected, sum(qty) FILTER (rk = 1)::DOUBLE AS actual FROM ranked)
    SELECT 'line' AS issue, expected, actual FROM k WHERE expected IS DISTINCT FROM actual UNION ALL SELECT 'source and lines', expected, actual FROM s WHERE expected IS DISTINCT FROM actual"""
)
def reconcile_issues(spark: SparkSession, d: str) -> DataFrame:
    """What the gate reports where lines come from the surest readings only and are held against all rows: every line that
    lost repeated readings, and the total."""
    rows = _rows(spark, d)
    return C.gate(rows, C.lines(R.unique(rows), R.SPEC, "qty", "conf"), rows.groupBy("board_id").agg(F.sum("qty").alias("quantity")), "qty", R.SPEC)


@query(
    f"""WITH {READINGS} SELECT 'rows' AS what, sum(qty)::BIGINT AS quantity FROM included UNION ALL SELECT 'lines', sum(x)::BIGINT FROM (SELECT sum(qty) AS x FROM included GROUP BY {_KEY})
    UNION ALL SELECT 'boards', sum(x)::BIGINT FROM (SELECT sum(qty) AS x FROM included GROUP BY board_id)"""
)
def reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    """The three totals that must agree."""
    rows = _rows(spark, d)
    one = lambda name, df, c: df.agg(F.sum(c).alias("quantity")).select(F.lit(name).alias("what"), "quantity")
    boards = rows.groupBy("board_id").agg(F.sum("qty").alias("q"))
    return one("rows", rows, "qty").union(one("lines", C.lines(rows, R.SPEC, "qty", "conf"), "quantity")).union(one("boards", boards, "q"))


@query(
    f"""WITH {READINGS} SELECT project_id, board, way, phase, array_to_string(list_sort(list(DISTINCT device)), ' / ') AS devices, count(*) AS n_rows
    FROM included WHERE way IS NOT NULL AND board != '' GROUP BY ALL HAVING count(DISTINCT device) > 1"""
)
def same_circuit(spark: SparkSession, d: str) -> DataFrame:
    """Circuits read with different devices."""
    rows = _rows(spark, d).where("way IS NOT NULL AND board != ''")
    seen = rows.groupBy("project_id", "board", "way", "phase").agg(F.collect_set("device").alias("seen"), F.count("*").alias("n_rows")).where(F.size("seen") > 1)
    return seen.select("project_id", "board", "way", "phase", F.array_join(F.array_sort("seen"), " / ").alias("devices"), "n_rows")


# --- coverage -------------------------------------------------------------------------------------------------------

_WAYS = got("ways_total", "^\\s*(\\d{1,3})")
_COVER = f"""{READINGS}, want AS (SELECT project_id, regexp_replace(upper({t('ref')}), '[\\s._/-]+', '', 'g') AS board, max(CASE WHEN try_cast({_WAYS} AS INTEGER) BETWEEN 2 AND 200 THEN try_cast({_WAYS} AS INTEGER) END) AS expected_ways FROM boards GROUP BY ALL),
  have AS (SELECT project_id, board, count(DISTINCT way) AS captured_ways, count(*) AS rows_captured FROM included GROUP BY ALL),
  cover AS (SELECT want.*, coalesce(captured_ways, 0) AS captured_ways, coalesce(rows_captured, 0) AS rows_captured,
    CASE WHEN expected_ways IS NOT NULL THEN greatest(0, expected_ways - coalesce(captured_ways, 0)) END AS unaccounted_ways FROM want LEFT JOIN have USING (project_id, board))"""


def _cover(spark: SparkSession, d: str) -> DataFrame:
    ways = F.regexp_extract("ways_total", r"^\s*(\d{1,3})", 1).try_cast("int")
    expected = table(spark, d, "boards").select("project_id", N.norm_board(F.col("ref")).alias("board"), F.when(ways.between(2, 200), ways).alias("ways"))
    return coverage.per_board(expected, _rows(spark, d), ["project_id", "board"], "ways", "way")


@query(f"WITH {_COVER} SELECT project_id, board, expected_ways, captured_ways, rows_captured, unaccounted_ways::BIGINT AS unaccounted_ways FROM cover")
def coverage_boards(spark: SparkSession, d: str) -> DataFrame:
    """Ways stated against ways captured, by board."""
    return _cover(spark, d)


@query(
    f"""WITH {_COVER} SELECT count(*) AS boards, count(*) FILTER (rows_captured > 0) AS boards_with_rows, sum(expected_ways)::BIGINT AS expected_ways, sum(least(captured_ways, expected_ways)) FILTER (expected_ways IS NOT NULL)::BIGINT AS captured_ways,
    round(100.0 * sum(least(captured_ways, expected_ways)) FILTER (expected_ways IS NOT NULL) / sum(expected_ways))::BIGINT AS pct_complete, count(*) FILTER (unaccounted_ways > 0) AS unaccounted_boards FROM cover"""
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coverage in all."""
    return coverage.summary(_cover(spark, d))


@query(
    """SELECT p.file_id, p.page, p.page_type FROM schedule_pages p WHERE trim(coalesce(text, '')) != '' AND page_type IN ('db-schedule', 'main-schedule', 'equipment-schedule')
    AND NOT EXISTS (SELECT 1 FROM devices d WHERE d.file_id = p.file_id AND d.page = p.page)"""
)
def zero_row_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that look like schedules, without a device."""
    return coverage.zero_row_pages(table(spark, d, "schedule_pages"), table(spark, d, "devices"), ["file_id", "page"]).select("file_id", "page", "page_type")


# --- comparing and merging ------------------------------------------------------------------------------------------


def _two_readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Device rows of schedule pages, and of all other pages."""
    pages = table(spark, d, "schedule_pages").select("file_id", "page", "page_type")
    rows = R.with_board(R.readings(table(spark, d, "devices"))).where("NOT space").join(pages, ["file_id", "page"])
    return rows.where("page_type = 'db-schedule'"), rows.where("page_type != 'db-schedule'")


_TWO = f"""{READINGS}, paged AS (SELECT r.*, page_type FROM readings r JOIN schedule_pages s ON r.file_id = s.file_id AND r.page = s.page WHERE NOT space),
  p AS (SELECT * FROM paged WHERE page_type = 'db-schedule' QUALIFY row_number() OVER (PARTITION BY project_id, board, way, phase ORDER BY rec_id DESC) = 1),
  s AS (SELECT * FROM paged WHERE page_type != 'db-schedule' QUALIFY row_number() OVER (PARTITION BY project_id, board, way, phase ORDER BY rec_id DESC) = 1),
  j AS (SELECT coalesce(p.project_id, s.project_id) AS project_id, coalesce(p.board, s.board) AS board, coalesce(p.way, s.way) AS way, coalesce(p.phase, s.phase) AS phase,
    p.rec_id AS pid, s.rec_id AS sid, p.rating AS pr, s.rating AS sr, p.device AS pd, s.device AS sd, p.pole AS pp, s.pole AS sp
    FROM p FULL JOIN s ON p.project_id = s.project_id AND p.board = s.board AND p.way IS NOT DISTINCT FROM s.way AND p.phase = s.phase)"""


@query(
    f"""WITH {_TWO} SELECT project_id, board, way, phase, 'missing_in_primary' AS kind, NULL AS field, NULL AS first_value, NULL AS second_value FROM j WHERE pid IS NULL
    UNION ALL SELECT project_id, board, way, phase, 'missing_in_second', NULL, NULL, NULL FROM j WHERE sid IS NULL
    UNION ALL SELECT project_id, board, way, phase, 'field_mismatch', 'rating', pr::VARCHAR, sr::VARCHAR FROM j WHERE pr != sr
    UNION ALL SELECT project_id, board, way, phase, 'field_mismatch', 'device', pd, sd FROM j WHERE pd != sd AND lower(pd) NOT IN ('spare', 'other device') AND lower(sd) NOT IN ('spare', 'other device')
    UNION ALL SELECT project_id, board, way, phase, 'field_mismatch', 'pole', pp, sp FROM j WHERE pp != sp"""
)
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Circuits that only one of two readings has, and fields on which they differ."""
    plain = lambda side: ~F.lower(F.col(f"{side}.device")).isin("spare", "other device")
    fields = {"rating": None, "device": (plain("p"), plain("s")), "pole": None}
    return crosscheck.cross_check(*_two_readings(spark, d), ["project_id", "board", "way", "phase"], fields, "rec_id")


@query(
    f"""WITH {READINGS}, paged AS (SELECT r.*, page_type FROM readings r JOIN schedule_pages s ON r.file_id = s.file_id AND r.page = s.page WHERE NOT space)
    SELECT e.rec_id FROM paged e WHERE page_type != 'db-schedule' AND NOT EXISTS (SELECT 1 FROM paged b WHERE b.page_type = 'db-schedule' AND b.project_id = e.project_id AND b.board = e.board
      AND b.way IS NOT DISTINCT FROM e.way AND (b.phase = '' OR e.phase = '' OR b.phase = e.phase OR e.phase = 'L1L2L3'))"""
)
def merge_fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Second readings that no first reading covers."""
    base, extra = _two_readings(spark, d)
    base = base.select("project_id", "board", "way", "phase").distinct()
    also = (F.col("b.phase") == "") | (F.col("e.phase") == "") | (F.col("b.phase") == F.col("e.phase")) | (F.col("e.phase") == "L1L2L3")
    return crosscheck.fill_gaps(base, extra, ["project_id", "board", "way"], also, "board = '' OR way IS NULL", "rec_id").select("rec_id")


_NORM = lambda c: f"regexp_replace(upper({t(c)}), '[\\s._/-]+', '', 'g')"
_CONFS = "coalesce(try_cast(regexp_extract(replace({c}, ',', '.'), '^([0-9]*\\.?[0-9]+)\\s*%?$', 1) AS DOUBLE) / CASE WHEN confidence LIKE '%\\%%' ESCAPE '\\' THEN 100 ELSE 1 END, 0)".format(c=t("confidence"))
_PARENTS = f"""fp AS (SELECT project_id, {_NORM('to_ref')} AS board, {_NORM('from_ref')} AS parent, {_CONFS} AS conf, feed_id FROM feeds),
  best_feed AS (SELECT project_id || '|' || board AS child, arg_max(parent, (conf, -feed_id)) AS parent, max(conf) AS conf FROM (SELECT DISTINCT * FROM fp) WHERE parent != '' AND board != '' AND parent != board GROUP BY 1)"""


def _best_feeds(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "feeds").select(
        "feed_id", F.concat_ws("|", "project_id", N.norm_board(F.col("to_ref"))).alias("child"), N.norm_board(F.col("to_ref")).alias("board"),
        N.norm_board(F.col("from_ref")).alias("parent"), R.confidence(F.col("confidence")).alias("conf"),
    )
    return C.first_best(feeds.where("parent != '' AND board != '' AND parent != board"), "child", "parent", F.col("conf"), "feed_id")


@query(f"WITH {_PARENTS} SELECT child, parent, round(conf, 6) AS score FROM best_feed")
def best_parent(spark: SparkSession, d: str) -> DataFrame:
    """The surest feed of each board, the first in a tie."""
    return _best_feeds(spark, d).select("child", "parent", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_PARENTS}, b AS (SELECT project_id || '|' || {_NORM('ref')} AS child, {_NORM('fed_from_ref')} AS parent, {_CONFS} AS conf, board_id FROM boards WHERE {_NORM('ref')} != ''),
    own AS (SELECT child, arg_max(parent, (conf, -board_id)) AS parent, max(conf) AS conf FROM b WHERE parent NOT IN ('', 'TBC', 'NA') GROUP BY 1)
    SELECT coalesce(o.child, f.child) AS child, CASE WHEN f.parent IS NOT NULL AND f.conf > coalesce(o.conf, 0) THEN f.parent ELSE o.parent END AS parent,
      round(CASE WHEN f.parent IS NOT NULL AND f.conf > coalesce(o.conf, 0) THEN f.conf ELSE o.conf END, 6) AS score,
      CASE WHEN o.child IS NULL THEN 'added' WHEN f.parent IS NOT NULL AND f.conf > coalesce(o.conf, 0) THEN 'replaced' ELSE 'kept' END AS action FROM own o FULL JOIN best_feed f USING (child)"""
)
def merge_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents from schedules, replaced by those from feeds that are surer."""
    boards = table(spark, d, "boards").select(
        "board_id", F.concat_ws("|", "project_id", N.norm_board(F.col("ref"))).alias("child"), N.norm_board(F.col("ref")).alias("own"),
        N.norm_board(F.col("fed_from_ref")).alias("parent"), R.confidence(F.col("confidence")).alias("conf"),
    )
    own = C.first_best(boards.where("own != '' AND parent NOT IN ('', 'TBC', 'NA')"), "child", "parent", F.col("conf"), "board_id")
    return crosscheck.upsert(own, _best_feeds(spark, d), ["child"], "parent", "score").withColumn("score", F.round("score", 6))


@query(
    f"""WITH r AS (SELECT *, project_id || '|' || {_NORM('ref')} AS board, {got('incomer_rating_a', '(\\d+(?:\\.\\d+)?)')}::DOUBLE AS rating, {t('phase_config')} AS phases FROM boards),
    o AS (SELECT board, rating, phases FROM r WHERE NOT continuation QUALIFY row_number() OVER (PARTITION BY board ORDER BY board_id) = 1),
    n AS (SELECT board, rating, phases FROM r WHERE continuation QUALIFY row_number() OVER (PARTITION BY board ORDER BY board_id) = 1)
    SELECT coalesce(o.board, n.board) AS board, 'added' AS change, NULL AS field, NULL AS old_value, NULL AS new_value FROM n LEFT JOIN o USING (board) WHERE o.board IS NULL
    UNION ALL SELECT o.board, 'removed', NULL, NULL, NULL FROM o LEFT JOIN n USING (board) WHERE n.board IS NULL
    UNION ALL SELECT board, 'changed', 'rating', o.rating::VARCHAR, n.rating::VARCHAR FROM o JOIN n USING (board) WHERE o.rating IS DISTINCT FROM n.rating
    UNION ALL SELECT board, 'changed', 'phases', o.phases, n.phases FROM o JOIN n USING (board) WHERE o.phases IS DISTINCT FROM n.phases"""
)
def revision_changes(spark: SparkSession, d: str) -> DataFrame:
    """Boards added, removed or changed between first pages and continuation pages."""
    rows = table(spark, d, "boards").select(
        "board_id", "continuation", F.concat_ws("|", "project_id", N.norm_board(F.col("ref"))).alias("board"),
        F.regexp_extract("incomer_rating_a", r"(\d+(?:\.\d+)?)", 1).try_cast("double").alias("rating"), N.text(F.col("phase_config")).alias("phases"),
    )
    side = lambda rule: dedup.keep_best(rows.where(rule), ["board"], -F.col("board_id"), "board_id").select("board", "rating", "phases")
    return crosscheck.changes(side("NOT continuation"), side("continuation"), ["board"], ["rating", "phases"])


# --- ordered fills --------------------------------------------------------------------------------------------------

_PHASED = f"""{READINGS}, ph AS (SELECT rec_id, file_id, page, way, phase, try_cast(substr(phase, 2) AS INTEGER) AS rk FROM readings WHERE phase IN ('L1', 'L2', 'L3'))"""


def _phased(spark: SparkSession, d: str) -> DataFrame:
    rows = R.readings(table(spark, d, "devices")).where(F.col("phase").isin("L1", "L2", "L3"))
    return rows.select("rec_id", "file_id", "page", "way", "phase", F.substring("phase", 2, 1).cast("int").alias("phase_rank"))


@query(
    f"""WITH {_PHASED}, w AS (SELECT *, last_value(way IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
      first_value(way IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY rec_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
      way IS NULL AND coalesce(rk <= lag(rk) OVER (PARTITION BY file_id, page ORDER BY rec_id), false) AS anew FROM ph)
    SELECT rec_id, coalesce(way, CASE WHEN NOT anew THEN prev END, nxt, prev + 1) AS filled_way, way IS NULL AND anew AND nxt IS NULL AND prev IS NOT NULL AS inferred FROM w"""
)
def fill_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways of rows without one, from the rows around them."""
    return sequences.fill_ways(_phased(spark, d), ["file_id", "page"], ["rec_id"]).select("rec_id", "filled_way", "inferred")


_GROUPS = f"""{_PHASED}, a AS (SELECT *, sum(CASE WHEN phase = 'L1' OR coalesce(l = 'L3', true) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, page ORDER BY rec_id) AS seg
      FROM (SELECT *, lag(phase) OVER (PARTITION BY file_id, page ORDER BY rec_id) AS l FROM ph)),
    b AS (SELECT *, greatest(count(way) OVER (PARTITION BY file_id, page, seg ORDER BY rec_id ROWS UNBOUNDED PRECEDING) - 1, 0) AS sub FROM a),
    g AS (SELECT *, dense_rank() OVER (PARTITION BY file_id, page ORDER BY seg, sub) AS group_no FROM b)"""


@query(f"WITH {_GROUPS} SELECT rec_id, group_no::INTEGER AS group_no FROM g")
def boundary_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one way, by phases and explicit ways."""
    return sequences.boundary_groups(_phased(spark, d), ["file_id", "page"], ["rec_id"]).select("rec_id", "group_no")


@query(
    f"""WITH {_GROUPS}, f AS (SELECT file_id, page, group_no, arg_min(way, rec_id) FILTER (way IS NOT NULL) AS w FROM g GROUP BY ALL),
    h AS (SELECT *, last_value(w IGNORE NULLS) OVER o + group_no - last_value(CASE WHEN w IS NOT NULL THEN group_no END IGNORE NULLS) OVER o AS group_way FROM f
      WINDOW o AS (PARTITION BY file_id, page ORDER BY group_no ROWS UNBOUNDED PRECEDING))
    SELECT rec_id, group_way::INTEGER AS group_way FROM g JOIN h USING (file_id, page, group_no)"""
)
def infer_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The way of each group, explicit or counted on from the last."""
    grouped = sequences.boundary_groups(_phased(spark, d), ["file_id", "page"], ["rec_id"])
    return sequences.infer_sequence(grouped, ["file_id", "page"], ["rec_id"]).select("rec_id", "group_way")


_BOARD_LINE = "Board Reference\\s+([^\\n]*?)(?:\\s*\\(continued\\))?\\s*(?:\\n|$)"


@query(
    f"""WITH p AS (SELECT file_id, page, page_type, {got('text', _BOARD_LINE)} AS own, page_type = 'unknown' AS resets FROM schedule_pages),
    s AS (SELECT *, sum(resets::INTEGER) OVER (PARTITION BY file_id ORDER BY page) AS seg FROM p)
    SELECT file_id, page, last_value(own IGNORE NULLS) OVER (PARTITION BY file_id, seg ORDER BY page ROWS UNBOUNDED PRECEDING) AS carried FROM s"""
)
def carry_board(spark: SparkSession, d: str) -> DataFrame:
    """The board of each page, carried over pages without a header until a page of unknown type."""
    pages = table(spark, d, "schedule_pages").withColumn("own", F.nullif(F.regexp_extract("text", "(?i)" + _BOARD_LINE.replace("$)", r"\z)"), 1), F.lit("")))
    return sequences.carry_forward(pages, ["file_id"], ["page"], "own", F.col("page_type") == "unknown").select("file_id", "page", "carried")


@query(
    f"""SELECT {_NORM('ref')} AS board, arg_max(ref, (length(ref), -board_id)) AS label, count(*) AS n_rows FROM boards WHERE ref IS NOT NULL GROUP BY 1"""
)
def board_labels(spark: SparkSession, d: str) -> DataFrame:
    """The longest spelling of each board, the first in a tie."""
    rows = table(spark, d, "boards").where("ref IS NOT NULL").withColumn("board", N.norm_board(F.col("ref")))
    pick = F.max_by("ref", F.struct(F.length("ref").alias("n"), (-F.col("board_id")).alias("o")))
    return rows.groupBy("board").agg(pick.alias("label"), F.count("*").alias("n_rows"))


_DIGITS = "regexp_replace(x, '^0+', '')"
_NATURAL = f"""array_to_string(list_transform(regexp_extract_all(lower(translate(form, {q(accents()[0])}, {q(accents()[1])})), '\\d+|\\D+'), lambda x: CASE WHEN NOT regexp_matches(x, '^\\d') THEN x
      WHEN length({_DIGITS}) > {DIGITS} THEN ':' || lpad(length({_DIGITS})::VARCHAR, 6, '0') || {_DIGITS} ELSE lpad({_DIGITS}, {DIGITS}, '0') END), '')"""


@query(f"WITH {READINGS}, {sql_keys('SELECT board AS r FROM included')} SELECT r AS board, {_NATURAL} AS key FROM keys WHERE r != ''")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Every board of the rows that count, numbers inside refs by value: a range sort of the key. The key is that of the ref's
    consistent form, so styled digits count as numbers. A row without a ref has no board."""
    boards = _rows(spark, d).select("board").distinct().where("board != ''")
    return boards.select("board", natural_key(consistent_form(F.col("board"))).alias("key")).orderBy("key", "board")


@query(
    f"""WITH f AS (SELECT DISTINCT * FROM feeds) SELECT {t('cable_csa_mm2')} AS csa, {t('cable_cpc_mm2')} AS cpc, {t('cable_desc')} AS cable, count(*) AS n_feeds, count(DISTINCT project_id) AS n_projects FROM f GROUP BY ALL"""
)
def cable_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Feeds by cable, each feed once."""
    feeds = table(spark, d, "feeds").distinct()
    keys = [N.text(F.col(c)).alias(a) for c, a in (("cable_csa_mm2", "csa"), ("cable_cpc_mm2", "cpc"), ("cable_desc", "cable"))]
    return feeds.groupBy(*keys).agg(F.count("*").alias("n_feeds"), F.count_distinct("project_id").alias("n_projects"))
