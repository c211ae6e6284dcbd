"""What pages say they hold against what was captured, and pages that should have rows but have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.patterns import has
from tallyforge.operators.dedup import keep_best

#: Board types and refs above distribution boards, out of scope where primary pages are known.
UPSTREAM_TYPES = ("MAIN", "MDB", "SMDB", "MCC", "SB", "PB")
UPSTREAM_REF = r"^(?:MAIN|MSB|SWB|SMDB|MDB|PB|MCC|MCP|GENERATOR)"
SCHEDULE_TYPES = ("db-schedule", "main-schedule", "equipment-schedule")


def in_scope(ref: Column, kind: Column | None = None) -> Column:
    out = ~has(F.regexp_replace(F.coalesce(ref, F.lit("")), r"[\s._/\\-]+", ""), UPSTREAM_REF)
    return out if kind is None else out & ~F.coalesce(F.upper(kind).isin(*UPSTREAM_TYPES), F.lit(False))


def per_board(expected: DataFrame, rows: DataFrame, keys: list[str], ways: str, slot: str) -> DataFrame:
    """``keys, expected_ways, captured_ways, rows_captured, unaccounted_ways`` of every board in ``expected``: the most
    ways any of its pages states, against distinct slots."""
    want = expected.groupBy(*keys).agg(F.max(ways).alias("expected_ways"))
    got = rows.groupBy(*keys).agg(F.count_distinct(F.col(slot)).alias("captured_ways"), F.count("*").alias("rows_captured"))
    zero = F.lit(0).cast("bigint")
    return want.join(got, keys, "left").select(
        *keys,
        "expected_ways",
        F.coalesce("captured_ways", zero).alias("captured_ways"),
        F.coalesce("rows_captured", zero).alias("rows_captured"),
        F.when(F.col("expected_ways").isNotNull(), F.greatest(zero, F.col("expected_ways") - F.coalesce("captured_ways", zero))).alias("unaccounted_ways"),
    )


def summary(boards: DataFrame) -> DataFrame:
    """One row: boards, those with rows, ways expected and captured, per cent complete, boards short of ways."""
    want = F.coalesce(F.sum("expected_ways"), F.lit(0))
    got = F.coalesce(F.sum(F.when(F.col("expected_ways").isNotNull(), F.least("captured_ways", "expected_ways"))), F.lit(0))
    return boards.agg(
        F.count("*").alias("boards"),
        F.count(F.when(F.col("rows_captured") > 0, 1)).alias("boards_with_rows"),
        want.cast("bigint").alias("expected_ways"),
        got.cast("bigint").alias("captured_ways"),
        F.when(want > 0, F.round(got * 100 / want)).cast("bigint").alias("pct_complete"),
        F.count(F.when(F.col("unaccounted_ways") > 0, 1)).alias("unaccounted_boards"),
    )


def looks_like_schedule(page_type: Column, text: Column) -> Column:
    said = F.coalesce(page_type.isin(*SCHEDULE_TYPES), F.lit(False))
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & (said | detect.looks_tabular(text) | detect.expected_ways(text).isNotNull())


def zero_row_pages(pages: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that look like schedules, without a row."""
    wanted = pages.where(looks_like_schedule(F.col("page_type"), F.col("text")))
    return wanted.join(rows.select(*keys).distinct(), keys, "left_anti")


HEADER = r"\bDB\s+REFERENCE\b|\b(?:DISTRIBUTION\s+)?BOARD\s*(?:REFERENCE|REF|IDENTITY)?\s*[:=\-]"
_NO_ROWS = ("mention", "manual")


class Coverage:
    """What pages state against what was captured, with the ownership of pages.

    boards: ``scope, board, ref, kind, file_id, page, primary`` (a row for each page that names a board); pages: ``file_id, page,
    page_type, text, ordinal`` (of rows for the same page the last counts); rows: ``scope, board, section, way, kind, file_id,
    page``. Where any page is known as a board's primary one, only primary pages speak for boards, upstream boards and those
    without a primary page are out of scope, and a page's rows must belong to a board that owns it. Pages of a board and
    boards of a page are few. Mentions and rows entered by hand are not captured rows. Null kinds count as rows. A null
    scope or board is a key of its own.
    """

    KEYS = ["scope", "board"]

    def __init__(self, boards: DataFrame, pages: DataFrame, rows: DataFrame, owned: bool | None = None) -> None:
        self.owned = bool(boards.where("primary").limit(1).count()) if owned is None else owned
        self.boards = boards
        self.refs = (boards.where("primary") if self.owned else boards).select(*self.KEYS, "file_id", "page").distinct()
        self.pages = keep_best(pages, ["file_id", "page"], F.col("ordinal"), "ordinal")
        self.rows = rows.where(~F.coalesce(F.col("kind").isin(*_NO_ROWS), F.lit(False)))

    def per_board(self) -> DataFrame:
        """``scope, board, expected_ways, evidence_file, evidence_page, captured_ways, rows_captured, unaccounted_ways, in_scope``:
        the most ways that a page of the board states, the first such page in a tie, and slots (section and way) with rows."""
        stated = self.pages.select("file_id", "page", detect.expected_ways(F.col("text"))["ways"].alias("ways")).where("ways IS NOT NULL")
        said = self.refs.join(stated, ["file_id", "page"])
        most = F.min_by(F.struct("ways", "file_id", "page"), F.struct((-F.col("ways")).alias("w"), "file_id", "page"))
        want = said.groupBy(*self.KEYS).agg(most.alias("e"))
        slot = F.when(F.col("way").isNotNull(), F.concat_ws(":", F.coalesce("section", F.lit("")), "way"))
        got = self.rows.groupBy(*self.KEYS).agg(F.count_distinct(slot).alias("captured_ways"), F.count("*").alias("rows_captured"))
        upstream = ~in_scope(F.col("ref"), F.col("kind"))
        named = self.boards.groupBy(*self.KEYS).agg(F.bool_or(upstream).alias("upstream"), F.bool_or(F.coalesce("primary", F.lit(False))).alias("primary"))
        zero, ways = F.lit(0).cast("bigint"), F.col("e.ways")
        scoped = F.col("primary") & ~F.col("upstream") if self.owned else F.lit(True)
        on = lambda a, b: a.alias("a").join(b.alias("b"), (F.col("a.scope").eqNullSafe(F.col("b.scope"))) & (F.col("a.board").eqNullSafe(F.col("b.board"))), "left").drop(F.col("b.scope"), F.col("b.board"))
        return on(on(named, want), got).select(
            *self.KEYS, ways.alias("expected_ways"), F.col("e.file_id").alias("evidence_file"), F.col("e.page").alias("evidence_page"), F.coalesce("captured_ways", zero).alias("captured_ways"),
            F.coalesce("rows_captured", zero).alias("rows_captured"), F.when(ways.isNotNull(), F.greatest(zero, ways - F.coalesce("captured_ways", zero))).alias("unaccounted_ways"), scoped.alias("in_scope"),
        )

    def zero_row_pages(self) -> DataFrame:
        """``file_id, page, page_type, boards``: pages that look like schedules of a board in scope, without a row of it."""
        text = F.col("text")
        told = detect.looks_tabular(text) | detect.expected_ways(text).isNotNull()
        filled = self.pages.where(F.trim(F.coalesce(text, F.lit(""))) != "")
        if not self.owned:
            wanted = filled.where(F.coalesce(F.col("page_type").isin(*SCHEDULE_TYPES), F.lit(False)) | told)
            return wanted.join(self.rows.select("file_id", "page").distinct(), ["file_id", "page"], "left_anti").select("file_id", "page", "page_type", F.array().cast("array<string>").alias("boards"))
        scoped = self.per_board().where("in_scope").select(*self.KEYS, F.lit(True).alias("scoped"))
        owners = self.refs.join(scoped, self.KEYS, "left")
        captured = self.rows.select(*self.KEYS, "file_id", "page").distinct().withColumn("has", F.lit(True))
        owners = owners.join(captured, [*self.KEYS, "file_id", "page"], "left")
        by_page = owners.groupBy("file_id", "page").agg(F.array_sort(F.collect_set("board")).alias("boards"), F.bool_or(F.coalesce("scoped", F.lit(False))).alias("s"), F.bool_or(F.coalesce("has", F.lit(False))).alias("h"))
        return filled.where(has(text, HEADER) | told).join(by_page.where("s AND NOT h"), ["file_id", "page"]).select("file_id", "page", "page_type", "boards")

    def issues(self, active: DataFrame) -> DataFrame:
        """``kind, n``: boards short of ways and pages without rows, of boards that are ``active`` (``scope, board``); pages
        without an owner always count."""
        names = active.select(*self.KEYS).distinct()
        short = self.per_board().where("unaccounted_ways > 0").join(names, self.KEYS, "left_semi").select(F.lit("short of ways").alias("kind"))
        pages = self.zero_row_pages().select("file_id", "page", F.explode_outer("boards").alias("board"))
        seen = pages.where("board IS NULL").unionByName(pages.join(names.select("board").distinct(), "board", "left_semi").select(*pages.columns))
        return short.unionByName(seen.select("file_id", "page").distinct().select(F.lit("pages without rows").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


def ground_truth(wanted: DataFrame, have_boards: DataFrame, have_rows: DataFrame, have_ways: DataFrame) -> DataFrame:
    """``doc, check, wanted, actual, passed`` of documents whose content is known.

    wanted: ``doc, check, board, wanted``; check ``board`` asks for a board, ``boards`` and ``rows`` for so many at least,
    ``ways`` for so many ways of a board. have_boards: ``doc, board``; have_rows: ``doc, n``; have_ways: ``doc, board, n``.
    Boards come as norms. Documents nothing is known of have no row; what is not there counts 0.
    """
    boards = have_boards.select("doc", "board").distinct()
    n_boards = boards.groupBy("doc").agg(F.count("*").alias("n")).select("doc", F.lit("boards").alias("check"), F.lit(None).cast("string").alias("board"), "n")
    have = (
        boards.select("doc", F.lit("board").alias("check"), "board", F.lit(1).cast("bigint").alias("n"))
        .unionByName(n_boards)
        .unionByName(have_rows.select("doc", F.lit("rows").alias("check"), F.lit(None).cast("string").alias("board"), F.col("n").cast("bigint").alias("n")))
        .unionByName(have_ways.select("doc", F.lit("ways").alias("check"), "board", F.col("n").cast("bigint").alias("n")))
    )
    w, h = wanted.alias("w"), have.alias("h")
    on = (F.col("w.doc") == F.col("h.doc")) & (F.col("w.check") == F.col("h.check")) & F.col("w.board").eqNullSafe(F.col("h.board"))
    actual = F.coalesce(F.col("h.n"), F.lit(0).cast("bigint"))
    return w.join(h, on, "left").select("w.doc", "w.check", "w.board", F.col("w.wanted").cast("bigint").alias("wanted"), actual.alias("actual"), (actual >= F.col("w.wanted")).alias("passed"))
