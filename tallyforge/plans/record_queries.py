"""Queries of the general operators on records: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import refs as R
from tallyforge.operators import hierarchy, orphans
from tallyforge.runtime import table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    boards, devices = table(spark, d, "boards"), table(spark, d, "devices")

    def child(df: DataFrame, name: str, id_: str, ref: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("src_table"), F.col(id_).alias("record_id"), F.lit("boards").alias("parent_table"), F.col("project_id").alias("scope"),
            R.board_key(F.col(ref)).alias("key"), F.col("received_at").alias("at"),
        )

    children = child(boards, "boards", "board_id", "fed_from_ref").unionByName(child(devices, "devices", "rec_id", "board_ref"))
    parents = boards.select(
        F.lit("boards").alias("parent_table"), F.col("project_id").alias("scope"), R.board_key(F.col("ref")).alias("key"), "received_at", "deleted_at"
    )
    return children, parents


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = orphans.orphans(*_references(spark, d))
    return out.select("src_table", "record_id", orphans.month_text(F.col("month")).alias("ref_month"))


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(*_references(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "boards").select(F.col("project_id").alias("scope"), R.board_key(F.col("ref")).alias("child"), R.board_key(F.col("fed_from_ref")).alias("parent"))
    b = table(spark, d, "feeds").select(F.col("project_id").alias("scope"), R.board_key(F.col("to_ref")).alias("child"), R.board_key(F.col("from_ref")).alias("parent"))
    return a.unionByName(b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.forest(_links(spark, d)).ancestors()
    return pairs.select(F.col("scope").alias("project_id"), "ancestor", F.col("node").alias("board"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    boards = table(spark, d, "boards").select(F.col("project_id").alias("scope"), R.board_key(F.col("ref")).alias("key"))
    out = hierarchy.forest(_links(spark, d), lone=boards).paths()
    return out.select(F.col("scope").alias("project_id"), F.col("node").alias("board"), "root", "depth", "path", "n_below", "on_circle")


# --- SQL twins ----------------------------------------------------------------------------------------------------


def sql_keys(sources: str) -> str:
    """CTEs ``keys(r, form, key)`` over the distinct refs ``r`` that the query ``sources`` gives."""
    plain = f"translate(r, {R._q(R.plain_table()[0])}, {R._q(R.plain_table()[1])})"
    n = {s: f"len(regexp_extract_all(pl, {R._q('[' + R.anchors(s) + ']')}))" for s in R.SCRIPTS}
    form = {s: f"translate(pl, {R._q(R.lookalike_table(s)[0])}, {R._q(R.lookalike_table(s)[1])})" for s in R.SCRIPTS}
    return f"""raws AS (SELECT DISTINCT r FROM ({sources}) WHERE r IS NOT NULL),
    plains AS MATERIALIZED (SELECT r, CASE WHEN regexp_full_match(r, '[ -~]*') THEN r ELSE {plain} END AS pl FROM raws),
    scripts AS MATERIALIZED (SELECT r, pl, {', '.join(f'{n[s]} AS {s}' for s in R.SCRIPTS)} FROM plains),
    forms AS MATERIALIZED (SELECT r, trim(nfc_normalize(CASE WHEN regexp_full_match(pl, '[ -~]*') THEN pl
      WHEN cyrillic > latin AND cyrillic >= greek THEN {form['cyrillic']}
      WHEN greek > latin AND greek > cyrillic THEN {form['greek']} ELSE {form['latin']} END)) AS form FROM scripts),
    keys AS MATERIALIZED (SELECT r, form, {R.sql_is_reference('form')} AS is_ref, {R.sql_key('form')} AS key FROM forms)"""


_REFS = "SELECT ref AS r FROM boards UNION ALL SELECT fed_from_ref FROM boards UNION ALL SELECT board_ref FROM devices"
_CHILDREN = f"""{sql_keys(_REFS)},
    children AS (
      SELECT 'boards' AS src_table, board_id AS record_id, project_id AS scope, key, date_trunc('month', received_at) AS m FROM boards JOIN keys ON fed_from_ref = r WHERE is_ref
      UNION ALL SELECT 'devices', rec_id, project_id, key, date_trunc('month', received_at) FROM devices JOIN keys ON board_ref = r WHERE is_ref),
    parents AS (SELECT project_id AS scope, key, received_at, deleted_at FROM boards JOIN keys ON ref = r WHERE is_ref),
    judged AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM parents p WHERE p.scope = c.scope AND p.key = c.key AND p.received_at < c.m + INTERVAL 1 MONTH
      AND (p.deleted_at IS NULL OR p.deleted_at >= c.m + INTERVAL 1 MONTH)) AS orphan FROM children c)"""
_EDGES = f"""{sql_keys('SELECT ref AS r FROM boards UNION ALL SELECT fed_from_ref FROM boards UNION ALL SELECT to_ref FROM feeds UNION ALL SELECT from_ref FROM feeds')},
    edges AS (SELECT project_id, child, min(parent) AS parent FROM (
      SELECT project_id, a.key AS child, b.key AS parent FROM boards JOIN keys a ON ref = a.r JOIN keys b ON fed_from_ref = b.r
      UNION ALL SELECT project_id, a.key, b.key FROM feeds JOIN keys a ON to_ref = a.r JOIN keys b ON from_ref = b.r)
      WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2)"""

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month, "p3_found": p3_found, "p3_paths": p3_paths}
SQL = {
    "p1_found": f"WITH {_CHILDREN} SELECT src_table, record_id, strftime(m, '%Y-%m') AS ref_month FROM judged WHERE orphan",
    "p1_by_month": f"""WITH {_CHILDREN} SELECT src_table, strftime(m, '%Y-%m') AS ref_month, count(*) AS n_refs, count(*) FILTER (orphan) AS n_orphans,
      count(DISTINCT CASE WHEN orphan THEN scope || chr(31) || key END) AS n_orphan_keys FROM judged GROUP BY 1, 2""",
    "p3_found": f"""WITH RECURSIVE {_EDGES},
      above AS (SELECT project_id, parent AS ancestor, child AS board FROM edges
        UNION SELECT a.project_id, e.parent, a.board FROM above a JOIN edges e ON e.project_id = a.project_id AND e.child = a.ancestor)
      SELECT project_id, ancestor, board FROM above""",
    "p3_paths": f"""WITH RECURSIVE {_EDGES},
      above AS (SELECT project_id, parent AS ancestor, child AS board FROM edges
        UNION SELECT a.project_id, e.parent, a.board FROM above a JOIN edges e ON e.project_id = a.project_id AND e.child = a.ancestor),
      ring AS (SELECT project_id, board FROM above WHERE ancestor = board),
      cut AS (SELECT project_id, board, min(ancestor) AS first FROM above SEMI JOIN ring USING (project_id, board) GROUP BY 1, 2),
      tree AS (SELECT e.* FROM edges e LEFT JOIN cut c ON c.project_id = e.project_id AND c.board = e.child WHERE c.first IS NULL OR c.first != e.child),
      nodes AS (SELECT project_id, child AS board FROM edges UNION SELECT project_id, parent FROM edges UNION SELECT project_id, key FROM boards JOIN keys ON ref = r WHERE key IS NOT NULL),
      walk AS (SELECT project_id, board, board AS root, 0::BIGINT AS depth, board AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.project_id = n.project_id AND t.child = n.board)
        UNION ALL SELECT w.project_id, t.child, w.root, w.depth + 1, w.path || ' > ' || t.child FROM walk w JOIN tree t ON t.project_id = w.project_id AND t.parent = w.board),
      under AS (SELECT project_id, parent AS board, child AS below FROM tree
        UNION ALL SELECT u.project_id, u.board, t.child FROM under u JOIN tree t ON t.project_id = u.project_id AND t.parent = u.below),
      sizes AS (SELECT project_id, board, count(*) AS n_below FROM under GROUP BY 1, 2)
      SELECT w.*, coalesce(n_below, 0) AS n_below, EXISTS (SELECT 1 FROM ring r WHERE r.project_id = w.project_id AND r.board = w.board) AS on_circle FROM walk w LEFT JOIN sizes USING (project_id, board)""",
}
