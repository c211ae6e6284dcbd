"""Queries of the report model under the five-part specification, and of coverage with the ownership of pages, with their
SQL twins. Devices take the breaking capacity of their board; a board's first page is its primary one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.functions.refs import board_key
from tallyforge.operators import consolidate as C
from tallyforge.operators import coverage
from tallyforge.operators.dedup import keep_best
from tallyforge.plans import report as R
from tallyforge.plans.record_queries import sql_keys
from tallyforge.plans.sqltext import READINGS, got, q, t
from tallyforge.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SPEC = ["device", "rating", "curve", "capacity", "pole"]
_UNKNOWN = {"curve": [N.NOT_SPECIFIED], "capacity": [N.NOT_SPECIFIED], "pole": [N.NOT_SPECIFIED, N.UNCLEAR]}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- boards by canonical name ---------------------------------------------------------------------------------------


def _canonical(df: DataFrame, ref: str) -> DataFrame:
    """Adds ``board`` and ``section`` of a ref column."""
    return df.withColumn("_b", N.canonical_board(F.col(ref))).withColumns({"board": F.col("_b.norm"), "section": F.col("_b.section")}).drop("_b")


def _canon(c: str) -> str:
    """SQL of struct(board, section) of a ref column."""
    shown = f"regexp_replace(regexp_replace(regexp_replace(upper({t(c)}), '\\s*[._/\\\\-]\\s*', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
    stem = f"regexp_extract({shown}, '^(DB(?:-[A-Z0-9]+)+)-(LP|L|P)$', 1)"
    split = f"regexp_matches({stem}, '-\\d{{1,3}}$')"
    return f"""regexp_replace(CASE WHEN {split} THEN {stem} ELSE {shown} END, '[\\s._/\\\\-]+', '', 'g') AS board, CASE WHEN {split} THEN regexp_extract({shown}, '-(LP|L|P)$', 1) END AS section"""


_CAPACITY = got(f"replace({t('fault_ka')}, ',', '.')", "(\\d+(?:\\.\\d+)?)")
_ROWS = f"""{READINGS},
  placed AS MATERIALIZED (SELECT d.rec_id, d.project_id, {_canon('board_ref')} FROM devices d),
  named AS MATERIALIZED (SELECT b.board_id AS id, b.project_id, {_canon('ref')}, b.ref, b.file_id, b.page, NOT b.continuation AS own, {_CAPACITY} AS ka FROM boards b),
  rated AS (SELECT project_id, board, regexp_replace(regexp_replace(printf('%.2f', ka::DOUBLE), '0+$', ''), '\\.$', '') || 'kA' AS capacity FROM named WHERE ka IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, board ORDER BY id DESC) = 1),
  model AS MATERIALIZED (SELECT i.* EXCLUDE (board, board_id), p.board, p.section, i.project_id || '|' || p.board AS board_id, coalesce(r.capacity, 'Not specified') AS capacity FROM included i JOIN placed p USING (rec_id) LEFT JOIN rated r ON r.project_id = p.project_id AND r.board = p.board)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Included readings with canonical board, section, and the capacity of the board's last reading that states one."""
    boards = _canonical(table(spark, d, "boards"), "ref").withColumn("capacity", N.breaking_capacity(F.col("fault_ka")))
    rated = keep_best(boards.where(F.col("capacity").endswith("kA") & F.col("capacity").rlike(r"^\d")), ["project_id", "board"], F.col("board_id"), "board_id").select("project_id", "board", "capacity")
    places = _canonical(table(spark, d, "devices").select("rec_id", "board_ref"), "board_ref").drop("board_ref")
    rows = R.included(R.readings(table(spark, d, "devices"))).drop("board").join(places, "rec_id")
    out = rows.join(rated, ["project_id", "board"], "left").withColumn("capacity", F.coalesce("capacity", F.lit(N.NOT_SPECIFIED)))
    return R.with_board(out)


# --- lines -----------------------------------------------------------------------------------------------------------

_KEY = ", ".join(SPEC)
_PLACES = lambda n: f"regexp_replace(regexp_replace(printf('%.2f', {n}), '0+$', ''), '\\.$', '')"
_RANK = " ".join(f"WHEN {q(p)} THEN {k}" for k, p in enumerate(R.PURPOSE_ORDER))


def _clash(a: str) -> str:
    others = [x for x in SPEC if x != a]
    known = f"{a} NOT IN ({', '.join(map(q, _UNKNOWN[a]))})"
    same = " AND ".join(f"c.{x} IS NOT DISTINCT FROM l.{x}" for x in others)
    return f"CASE WHEN l.{known} AND EXISTS (SELECT 1 FROM sums c WHERE c.{known} AND c.{a} != l.{a} AND {same}) THEN {q(a)} END"


_SUMS = f"""sums AS MATERIALIZED (SELECT grp, {_KEY}, sum(qty)::BIGINT AS quantity, count(*) AS n_rows, round(least(1.0, min(conf)), 6)::DOUBLE AS confidence, count(DISTINCT board_id) AS n_boards,
    list_sort(list(DISTINCT purpose)) AS found FROM model GROUP BY ALL),
  marked AS MATERIALIZED (SELECT l.*, concat_ws(', ', {', '.join(map(_clash, _UNKNOWN))}) AS conflicts FROM sums l),
  lined AS MATERIALIZED (SELECT *, list_aggregate(list_transform(list_sort(list_transform(found, lambda x: {{r: CASE x {_RANK} ELSE 99 END, x: x}})), lambda y: y.x), 'string_agg', ', ') AS applications,
    concat_ws('; ', CASE WHEN rating IS NULL THEN 'rating missing' END, CASE WHEN curve = 'Not specified' THEN 'curve not specified' END, CASE WHEN capacity = 'Not specified' THEN 'breaking capacity not specified' END,
      CASE WHEN pole IN ('Unclear', 'Not specified') THEN 'pole configuration unclear' END, CASE WHEN confidence < 0.8 THEN 'low confidence' END, CASE WHEN conflicts != '' THEN 'conflicting ' || conflicts END) AS reasons FROM marked)"""


def _model(spark: SparkSession, d: str) -> DataFrame:
    return R.model_lines(_rows(spark, d), SPEC, _UNKNOWN)


@query(f"WITH {_ROWS}, {_SUMS} SELECT grp, {_KEY}, quantity, n_rows, n_boards, confidence, applications, conflicts, reasons, CASE WHEN reasons = '' THEN 'Ready' ELSE 'Review required' END AS status FROM lined")
def specification_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines under the five-part specification with applications in their fixed order, conflicts, reasons and status."""
    return _model(spark, d).select("grp", *SPEC, "quantity", "n_rows", "n_boards", "confidence", "applications", "conflicts", "reasons", "status")


@query(
    f"""WITH {_ROWS}, s AS (SELECT {_KEY}, coalesce(file_id, 'Not specified') AS document, 'p' || array_to_string(list_sort(list(DISTINCT page)), ', p') AS pages FROM model WHERE page IS NOT NULL GROUP BY ALL)
    SELECT {_KEY}, string_agg(document || ' ' || pages, '; ' ORDER BY document) AS sources FROM s GROUP BY ALL"""
)
def line_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pages behind each line, as one text."""
    return R.line_sources(_rows(spark, d), SPEC)


@query(f"WITH {_ROWS} SELECT {_KEY}, board_id, grouping({_KEY}, board_id)::BIGINT AS level, sum(qty)::BIGINT AS quantity FROM model GROUP BY GROUPING SETS (({_KEY}, board_id), ({_KEY}), (board_id), ())")
def board_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by line and board with both margins and the grand total, one cell a row: boards are too many for columns."""
    rows = _rows(spark, d)
    sets = [[F.col(c) for c in x] for x in ([*SPEC, "board_id"], SPEC, ["board_id"], [])]
    return rows.groupingSets(sets, *[F.col(c) for c in (*SPEC, "board_id")]).agg(F.grouping_id().cast("bigint").alias("level"), F.sum("qty").alias("quantity"))


@query(
    f"""WITH {_ROWS}, {_SUMS}, s AS (SELECT {_KEY}, coalesce(file_id, 'Not specified') AS document, 'p' || array_to_string(list_sort(list(DISTINCT page)), ', p') AS pages FROM model WHERE page IS NOT NULL GROUP BY ALL),
    o AS (SELECT {_KEY}, string_agg(document || ' ' || pages, '; ' ORDER BY document) AS sources FROM s GROUP BY ALL)
    SELECT l.grp AS category, concat_ws(' ', CASE WHEN l.rating IS NULL THEN 'Not specified' ELSE {_PLACES('l.rating')} || 'A' END, CASE WHEN upper(l.device) IN ('MCB', 'RCBO', 'AFDD+RCBO', 'MCCB', 'ACB', 'RCD') THEN l.pole END, l.device) AS label,
      CASE WHEN l.rating IS NULL THEN 'Not specified' ELSE {_PLACES('l.rating')} END AS rating, l.pole, l.curve, l.capacity, l.quantity, applications, sources, confidence, CASE WHEN reasons = '' THEN 'Ready' ELSE 'Review required' END AS status,
      concat_ws(' ', {', '.join(f"CASE WHEN {cond} THEN {q(R.NOTES[k])} END" for k, cond in (('rating', 'l.rating IS NULL'), ('curve', "l.curve = 'Not specified'"), ('capacity', "l.capacity = 'Not specified'"), ('pole', "l.pole IN ('Unclear', 'Not specified')")))},
        {', '.join(f"CASE WHEN contains(', ' || conflicts || ',', ', {a},') THEN {q(R.CONFLICT_NOTES[a])} END" for a in _UNKNOWN)}) AS notes
    FROM lined l LEFT JOIN o ON {' AND '.join(f'o.{x} IS NOT DISTINCT FROM l.{x}' for x in SPEC)}
    UNION ALL SELECT 'Grand Total', NULL, NULL, NULL, NULL, NULL, sum(quantity)::BIGINT, NULL, NULL, NULL, NULL, NULL FROM lined"""
)
def takeoff_lines(spark: SparkSession, d: str) -> DataFrame:
    """The take-off sheet without its board columns, in report order, the grand total last."""
    rows = _rows(spark, d)
    return R.takeoff_lines(R.model_lines(rows, SPEC, _UNKNOWN), R.line_sources(rows, SPEC), SPEC)


@query(
    f"""WITH {_ROWS}, {_SUMS}, s AS (SELECT {_KEY}, quantity, unnest(string_split(reasons, '; ')) AS reason FROM lined WHERE reasons != '')
    SELECT {_KEY}, quantity, reason, CASE WHEN reason LIKE 'conflicting%' THEN 'Conflict' WHEN reason LIKE '%curve%' THEN 'Tripping curve' WHEN reason LIKE '%capacity%' THEN 'Breaking capacity' WHEN reason LIKE '%pole%' THEN 'Pole configuration' WHEN reason LIKE '%rating%' THEN 'Current rating' ELSE 'Source record' END AS field FROM s"""
)
def review_items(spark: SparkSession, d: str) -> DataFrame:
    """Everything that needs a look, one reason a row, conflicts between lines included."""
    return R.review_items(_model(spark, d), SPEC)


_EVIDENCE = ("device", "rating", "curve", "capacity", "pole")


@query(
    f"""WITH {_ROWS}, dup AS (SELECT rec_id, row_number() OVER w > 1 AS repeated, first_value(rec_id) OVER w AS kept FROM model WINDOW w AS (PARTITION BY project_id, board, way, phase, {_KEY} ORDER BY conf DESC, rec_id)),
    cells AS ({' UNION ALL '.join(f"SELECT rec_id, '{c}' AS field, {_PLACES('rating') if c == 'rating' else c} AS value, conf, file_id, page FROM model" for c in _EVIDENCE)})
    SELECT c.rec_id, field, CASE WHEN field = 'rating' AND value IS NULL THEN NULL ELSE value END AS value, round(conf, 6) AS confidence, file_id, page,
      CASE WHEN value IS NULL OR value IN ('Not specified', 'Unclear', 'Other device') THEN 'Review required' WHEN repeated THEN 'Excluded duplicate' ELSE 'Read from source' END AS status, CASE WHEN repeated THEN kept END AS retained FROM cells c JOIN dup USING (rec_id)"""
)
def audit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every specification field of every row with value, confidence, place and status; repeated readings name the row kept."""
    return R.audit_evidence(_rows(spark, d), ["project_id", "board", "way", "phase", *SPEC], SPEC)


# --- coverage -------------------------------------------------------------------------------------------------------

_TYPES = tuple(coverage.UPSTREAM_TYPES)
_KIND = f"regexp_extract(board, '^({'|'.join(_TYPES)})', 1)"


def _coverage(spark: SparkSession, d: str) -> coverage.Coverage:
    """Boards by page, pages with the ways that boards on them state, and rows by section and way."""
    boards = _canonical(table(spark, d, "boards"), "ref")
    refs = boards.select(
        F.col("project_id").alias("scope"), "board", "ref", F.nullif(F.regexp_extract("board", f"^({'|'.join(_TYPES)})", 1), F.lit("")).alias("kind"), "file_id", "page", (~F.col("continuation")).alias("primary")
    )
    ways = F.regexp_extract("ways_total", r"^\s*(\d{1,3})", 1)
    said = boards.where(ways != "").groupBy("file_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("board_id", F.concat(F.lit("No. of ways: "), ways).alias("x")))), lambda y: y["x"]), "\n").alias("said"))
    pages = table(spark, d, "schedule_pages").join(said, ["file_id", "page"], "left")
    text = F.when(F.col("text").isNotNull(), F.concat_ws("\n", F.lit("BOARD REFERENCE:"), "said"))
    pages = pages.select("file_id", "page", "page_type", text.alias("text"), F.lit(0).alias("ordinal"))
    rows = _rows(spark, d).select(F.col("project_id").alias("scope"), "board", "section", "way", F.lit("row").alias("kind"), "file_id", "page")
    return coverage.Coverage(refs, pages, rows)


_COVER = f"""{_ROWS},
  ways AS (SELECT file_id, page, arg_min(try_cast(w AS INTEGER), board_id) AS n FROM (SELECT *, regexp_extract(ways_total, '^\\s*(\\d{{1,3}})', 1) AS w FROM boards) WHERE w != '' GROUP BY 1, 2),
  stated AS (SELECT s.*, CASE WHEN text IS NOT NULL AND n BETWEEN 2 AND 200 THEN n END AS ways FROM schedule_pages s LEFT JOIN ways USING (file_id, page)),
  owner AS (SELECT DISTINCT project_id, board, file_id, page FROM named WHERE own),
  want AS (SELECT project_id, board, max(ways) AS expected_ways, arg_min((file_id, page), (-ways, file_id, page)) AS e FROM owner JOIN stated USING (file_id, page) WHERE ways IS NOT NULL GROUP BY 1, 2),
  have AS (SELECT project_id, board, count(DISTINCT CASE WHEN way IS NOT NULL THEN coalesce(section, '') || ':' || way END) AS captured_ways, count(*) AS rows_captured FROM model GROUP BY 1, 2),
  scoped AS (SELECT project_id, board, bool_or(own) AND NOT bool_or({_KIND} != '' OR regexp_matches(regexp_replace({t('ref')}, '[\\s._/\\\\-]+', '', 'g'), {q(coverage.UPSTREAM_REF)}, 'i')) AS in_scope FROM named GROUP BY 1, 2),
  cover AS MATERIALIZED (SELECT s.project_id AS scope, s.board, expected_ways, e[1] AS evidence_file, e[2] AS evidence_page, coalesce(captured_ways, 0) AS captured_ways, coalesce(rows_captured, 0) AS rows_captured,
    CASE WHEN expected_ways IS NOT NULL THEN greatest(0, expected_ways - coalesce(captured_ways, 0)) END::BIGINT AS unaccounted_ways, in_scope
    FROM scoped s LEFT JOIN want w ON w.project_id = s.project_id AND w.board = s.board LEFT JOIN have h ON h.project_id = s.project_id AND h.board = s.board),
  empty_pages AS MATERIALIZED (SELECT p.file_id, p.page, p.page_type, (SELECT list_sort(list(DISTINCT board)) FROM owner o WHERE o.file_id = p.file_id AND o.page = p.page) AS owners FROM stated p WHERE text IS NOT NULL
    AND EXISTS (SELECT 1 FROM owner o JOIN cover c ON c.scope = o.project_id AND c.board = o.board WHERE in_scope AND o.file_id = p.file_id AND o.page = p.page)
    AND NOT EXISTS (SELECT 1 FROM owner o JOIN model m ON m.project_id = o.project_id AND m.board = o.board AND m.file_id = o.file_id AND m.page = o.page WHERE o.file_id = p.file_id AND o.page = p.page))"""


@query(f"WITH {_COVER} SELECT * FROM cover")
def coverage_by_board(spark: SparkSession, d: str) -> DataFrame:
    """Ways that a board's primary pages state, with the page that says so, against slots captured, and its scope."""
    return _coverage(spark, d).per_board()


@query(
    f"""WITH {_COVER} SELECT count(*) AS boards, count(*) FILTER (rows_captured > 0) AS boards_with_rows, coalesce(sum(expected_ways), 0)::BIGINT AS expected_ways, coalesce(sum(least(captured_ways, expected_ways)) FILTER (expected_ways IS NOT NULL), 0)::BIGINT AS captured_ways,
    round(100.0 * sum(least(captured_ways, expected_ways)) FILTER (expected_ways IS NOT NULL) / sum(expected_ways))::BIGINT AS pct_complete, count(*) FILTER (unaccounted_ways > 0) AS unaccounted_boards FROM cover WHERE in_scope"""
)
def coverage_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the boards in scope, in all."""
    return coverage.summary(_coverage(spark, d).per_board().where("in_scope"))


@query(f"WITH {_COVER} SELECT file_id, page, page_type, array_to_string(owners, ', ') AS boards FROM empty_pages")
def owned_pages_without_rows(spark: SparkSession, d: str) -> DataFrame:
    """Schedule pages of boards in scope without a row of a board that owns them."""
    return _coverage(spark, d).zero_row_pages().withColumn("boards", F.array_join("boards", ", "))


@query(
    f"""WITH {_COVER}, a AS (SELECT DISTINCT project_id AS scope, board FROM model),
    i AS (SELECT 'short of ways' AS kind FROM cover c SEMI JOIN a ON a.scope = c.scope AND a.board = c.board WHERE unaccounted_ways > 0
      UNION ALL SELECT 'pages without rows' FROM empty_pages e WHERE len(owners) = 0 OR EXISTS (SELECT 1 FROM a WHERE list_contains(e.owners, a.board))) SELECT kind, count(*) AS n FROM i GROUP BY 1"""
)
def coverage_issues(spark: SparkSession, d: str) -> DataFrame:
    """Shortfalls of boards that take part in the report."""
    return _coverage(spark, d).issues(_rows(spark, d).select(F.col("project_id").alias("scope"), "board"))


_TRUTH = f"""{_ROWS}, fed AS (SELECT DISTINCT project_id, {_canon('to_ref')} FROM feeds),
  wanted AS (SELECT project_id AS doc, 'board' AS "check", board, 1 AS wanted FROM fed WHERE board != '' GROUP BY ALL UNION ALL SELECT project_id, 'boards', NULL, count(*) FROM files GROUP BY 1
    UNION ALL SELECT project_id, 'rows', NULL, sum(page_count)::BIGINT FROM files GROUP BY 1
    UNION ALL SELECT project_id, 'ways', board, max(try_cast(w AS INTEGER)) FROM (SELECT b.project_id, {_canon('ref')}, regexp_extract(ways_total, '^\\s*(\\d{{1,3}})', 1) AS w FROM boards b) WHERE w != '' GROUP BY 1, 3),
  have AS (SELECT project_id AS doc, 'board' AS "check", board, 1 AS n FROM named GROUP BY ALL UNION ALL SELECT project_id, 'boards', NULL, count(DISTINCT board) FROM named GROUP BY 1 UNION ALL SELECT project_id, 'rows', NULL, count(*) FROM model GROUP BY 1
    UNION ALL SELECT project_id, 'ways', board, count(DISTINCT way) FROM model GROUP BY 1, 3)"""


@query(
    f"""WITH {_TRUTH} SELECT w.doc, w."check", w.board, w.wanted::BIGINT AS wanted, coalesce(n, 0)::BIGINT AS actual, coalesce(n, 0) >= wanted AS passed FROM wanted w LEFT JOIN have h ON h.doc = w.doc AND h."check" = w."check" AND h.board IS NOT DISTINCT FROM w.board"""
)
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each project held against what was captured: boards that feeds name, a board a file and a row a page
    at least, and the ways that headers state."""
    none = F.lit(None).cast("string").alias("board")
    boards, files = _canonical(table(spark, d, "boards"), "ref"), table(spark, d, "files")
    fed = _canonical(table(spark, d, "feeds").select("project_id", "to_ref"), "to_ref").where("board != ''").select(F.col("project_id").alias("doc"), "board").distinct()
    ways = F.regexp_extract("ways_total", r"^\s*(\d{1,3})", 1)
    per_file = files.groupBy(F.col("project_id").alias("doc"))
    wanted = (
        fed.select("doc", F.lit("board").alias("check"), "board", F.lit(1).cast("bigint").alias("wanted"))
        .unionByName(per_file.agg(F.count("*").alias("wanted")).select("doc", F.lit("boards").alias("check"), none, "wanted"))
        .unionByName(per_file.agg(F.sum("page_count").alias("wanted")).select("doc", F.lit("rows").alias("check"), none, "wanted"))
        .unionByName(boards.where(ways != "").groupBy(F.col("project_id").alias("doc"), "board").agg(F.max(ways.cast("bigint")).alias("wanted")).select("doc", F.lit("ways").alias("check"), "board", "wanted"))
    )
    rows = _rows(spark, d).withColumn("doc", F.col("project_id"))
    by_board = rows.groupBy("doc", "board").agg(F.count_distinct("way").alias("n"))
    return coverage.ground_truth(wanted, boards.select(F.col("project_id").alias("doc"), "board"), rows.groupBy("doc").agg(F.count("*").alias("n")), by_board)


# --- boards by key ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {READINGS}, {sql_keys('SELECT board_ref AS r FROM devices')} SELECT i.project_id, k.key, count(DISTINCT i.board) AS n_spellings, sum(qty)::BIGINT AS quantity, count(DISTINCT i.way) AS n_ways FROM included i JOIN devices d USING (rec_id) LEFT JOIN keys k ON k.r = d.board_ref GROUP BY 1, 2"""
)
def totals_by_board_key(spark: SparkSession, d: str) -> DataFrame:
    """Quantities and ways of boards under the board key, and under how many plain names each goes."""
    keys = table(spark, d, "devices").select("rec_id", board_key(F.col("board_ref")).alias("key"))
    rows = R.included(R.readings(table(spark, d, "devices"))).join(keys, "rec_id")
    return rows.groupBy("project_id", "key").agg(F.count_distinct("board").alias("n_spellings"), F.sum("qty").alias("quantity"), F.count_distinct("way").alias("n_ways"))
