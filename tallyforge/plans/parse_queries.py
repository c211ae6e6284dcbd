"""Queries of the parsers and page operators, and their SQL twins. Page texts of the tables hold headers only, so schedule
lines and sentences are written from the device, board and feed tables (``rendered``) and read back; the twins know from
the tables what must come back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import detect, quality, refs
from tallyforge.functions import normalise as N
from tallyforge.functions.patterns import collapsed, first
from tallyforge.operators import classify, spatial
from tallyforge.plans import parse, rendered
from tallyforge.plans import report as R
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


def _read_back(layout: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return rendered.read_back(spark, d, layout)

    f.__name__, f.__doc__ = f"parsed_{layout}", f"Rows read back from the device table written in the layout ``{layout}``."
    return query(rendered.SQL[layout])(f)


for _layout in rendered.LAYOUTS:
    _read_back(_layout)


# --- texts written from the tables -----------------------------------------------------------------------------------

_N = r"^(\d+(?:\.\d+)?)$"


def _case(c: Column, *texts: Column) -> Column:
    """The text for the numbers 0, 1, ... of a column."""
    out = F.when(c == 0, texts[0])
    for k, x in enumerate(texts[1:], 1):
        out = out.when(c == k, x)
    return out


def _say(template: str, **cells: Column) -> Column:
    """A template with ``{name}`` replaced by columns, as text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[cells[x].cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts) if k % 2 or x])


@query(
    """WITH f AS (SELECT DISTINCT feed_id, feed_id % 5 AS form, 'MSB' || (feed_id % 7 + 1) AS msb FROM feeds)
    SELECT feed_id, CASE form WHEN 2 THEN 'TRANSFORMER' WHEN 4 THEN NULL ELSE msb END AS from_key, CASE WHEN form = 4 THEN 'SMDB' ELSE 'DB' END || feed_id AS to_key, CASE WHEN form = 4 THEN 0.6 ELSE 0.85 END::DOUBLE AS conf FROM f"""
)
def feeder_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Feeds that sentences tell, each feed of the table in one of five wordings."""
    feeds = table(spark, d, "feeds").select("feed_id").distinct()
    x = {"id": F.col("feed_id"), "k": F.col("feed_id") % 7 + 1}
    words = ("Sub-main to DB-{id} in tray", "DB-{id} fed from MSB{k}", "DB-{id} supplied from transformer T{k}", "MSB{k} supplies DB-{id}", "Outgoing feeder to SMDB-{id}")
    context = F.when(F.col("feed_id") % 5 == 0, _say("MSB{k}", **x))
    return parse.feeders(feeds.select("feed_id", _case(F.col("feed_id") % 5, *[_say(w, **x) for w in words]).alias("text"), context.alias("context")))


_CABLE = "coalesce(nullif(regexp_extract(cable_csa_mm2, '^(\\d+(?:\\.\\d+)?)$', 1), ''), '4')"


@query(
    f"""WITH f AS (SELECT DISTINCT feed_id, feed_id % 5 AS form, (feed_id % 4 + 1)::VARCHAR AS n, {_CABLE} AS csa FROM feeds)
    SELECT feed_id, CASE form WHEN 0 THEN n || 'C ' || csa || 'mm2' WHEN 1 THEN '6242Y ' || csa || 'mm2' WHEN 2 THEN csa || '/1.5 mm2' WHEN 3 THEN csa || 'mm CPC' ELSE '3 x ' || csa || 'mm²' END AS orig,
      CASE form WHEN 0 THEN n::DOUBLE WHEN 4 THEN 3 END::DOUBLE AS cores, CASE WHEN form != 3 THEN csa::DOUBLE END AS size, CASE form WHEN 2 THEN 1.5 WHEN 3 THEN csa::DOUBLE END::DOUBLE AS cpc,
      CASE form WHEN 0 THEN 'XLPE/SWA' WHEN 1 THEN '6242Y flat T&E' WHEN 2 THEN 'LSF' END AS construction FROM f"""
)
def cables(spark: SparkSession, d: str) -> DataFrame:
    """Cables that texts name, each feed of the table in one of five notations."""
    feeds = table(spark, d, "feeds").select("feed_id", F.coalesce(F.nullif(F.regexp_extract("cable_csa_mm2", _N, 1), F.lit("")), F.lit("4")).alias("csa")).distinct()
    x = {"csa": F.col("csa"), "n": F.col("feed_id") % 4 + 1}
    words = ("{n}C {csa}mm2 XLPE SWA", "6242Y {csa}mm2", "{csa}/1.5 mm2 LSF", "{csa}mm CPC", "3 x {csa}mm² and 3 x {csa}mm²")
    texts = feeds.select("feed_id", _case(F.col("feed_id") % 5, *[_say(w, **x) for w in words]).alias("text"))
    return texts.select("feed_id", F.explode(detect.cables(F.col("text"))).alias("c")).select("feed_id", "c.*")


_REST, _MISREAD = {"1": "0", "2": "6", "3": "00", "4": "25"}, {"RCBO": "RC8O", "MCCB": "MCC8"}


@query(
    f"""WITH {rendered.BASE} SELECT rec_id, 'Circuit ' || way || ': 1' || {rendered.sql_pick('n::VARCHAR', _REST, '0')} || 'A ' || {rendered.sql_pick('device', {k: k for k in _MISREAD}, 'MCB')} || ' Type ' || curve || ' ' || n || '0kA' AS text,
      CASE WHEN way = 1 THEN 4 ELSE 3 END::INTEGER AS n_corrections FROM base"""
)
def misread_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Misread characters put right: devices of the table written with l, 8 and O for 1, B and 0."""
    b = rendered.base(spark, d)
    number = F.when(F.col("way") == 1, "l").otherwise(F.col("way").cast("string"))
    x = {"way": number, "rest": rendered.pick(F.col("n").cast("string"), _REST, "0"), "device": rendered.pick(F.col("device"), _MISREAD, "MC8"), "curve": F.col("curve"), "n": F.col("n")}
    texts = b.select("rec_id", _say("Circuit {way}: l{rest}A {device} Type {curve} {n}OkA", **x).alias("t"))
    return texts.select("rec_id", detect.corrected(F.col("t")).alias("c")).select("rec_id", "c.text", F.size("c.corrections").alias("n_corrections"))


@query(f"WITH {rendered.BASE} SELECT rec_id, CASE WHEN n < 4 THEN curve END AS curve, CASE WHEN n = 1 THEN amps % 50 + 1 END::DOUBLE AS ka FROM base")
def curve_and_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Tripping curves and breaking capacities that texts name, each device in one of four wordings, one of which names a
    revision; ``device_curves`` reads the texts of the table itself."""
    x = {"amps": F.col("amps"), "curve": F.col("curve"), "ka": F.col("amps") % 50 + 1}
    words = ("{amps}A MCB Type {curve}, {ka} kA", "{curve}-curve breaker", "MCB {curve}{amps}", "Board {curve}12 rev")
    texts = rendered.base(spark, d).select("rec_id", _case(F.col("n") - 1, *[_say(w, **x) for w in words]).alias("t"))
    return texts.select("rec_id", detect.tripping_curve(F.col("t"))["value"].alias("curve"), detect.breaking_capacity(F.col("t")).alias("ka"))


_LETTERS_OF = f"CASE WHEN device IN ({', '.join(map(q, rendered.NAMED))}) THEN device ELSE 'MCB' END"
_POLE_WORDS = {"1": "SP", "2": "DP", "3": "TP", "4": "4P"}


@query(
    f"""WITH {rendered.BASE} SELECT rec_id, {_LETTERS_OF} AS device, amps::DOUBLE AS rating, {rendered.sql_pick('n::VARCHAR', _POLE_WORDS, '')} AS pole, n::INTEGER AS poles, coalesce(ma, 30)::DOUBLE AS sens, phase, n::DOUBLE AS qty FROM base"""
)
def fields_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Device, rating, poles in words and number, sensitivity, phase and quantity that sentences about devices tell."""
    b = rendered.base(spark, d)
    named = F.when(F.col("device").isin(*rendered.NAMED), F.col("device")).otherwise("MCB")
    pole = rendered.pick(F.col("n").cast("string"), {"1": "single-pole", "2": "double-pole", "3": "triple-pole TP", "4": "four-pole"}, "")
    x = {"n": F.col("n"), "amps": F.col("amps"), "device": named, "pole": pole, "ma": F.coalesce("ma", F.lit(30)), "phase": F.col("phase"), "descr": F.col("descr")}
    t_ = F.col("t")
    texts = b.select("rec_id", _say("{n} x {amps}A {device} {pole} {ma}mA on {phase} for {descr}", **x).alias("t")).withColumn("device", detect.device(t_))
    return texts.select(
        "rec_id", "device", detect.rating(t_).alias("rating"), detect.pole_wording(t_).alias("pole"), detect.poles(t_).alias("poles"), detect.sensitivity(t_).alias("sens"), detect.phase(t_).alias("phase"),
        detect.quantity(t_, F.col("device")).alias("qty"),
    )


@query(
    """WITH b AS (SELECT board_id, board_id % 6 AS form, (board_id % 10000)::VARCHAR AS n FROM boards), k AS (SELECT board_id, unnest(CASE form WHEN 0 THEN ['DB' || n || 'X'] WHEN 1 THEN ['MAINLVPANEL'] WHEN 2 THEN ['CUFLAT' || n, 'MSB1']
      WHEN 3 THEN ['G1GFDBL' || n, 'SMDB2A'] WHEN 4 THEN ['2A' || n] ELSE [] END) AS key FROM b) SELECT * FROM k"""
)
def board_refs_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Refs of boards in sentences, each board of the table in one of six wordings; ``page_board_refs`` reads the page table."""
    words = (
        "Distribution board DB-{n}-X on level 0", "DB Schedule fed from the main LV panel", "Consumer Unit (Flat {n}) and MSB1", "G1-GF-DB-L{n} next to SMDB-2A", "Board Reference: 2A{n}", "Drawing Reference: E-{n}",
    )
    n = {"n": F.col("board_id") % 10000}
    texts = table(spark, d, "boards").select("board_id", _case(F.col("board_id") % 6, *[_say(w, **n) for w in words]).alias("t"))
    return texts.select("board_id", F.explode(detect.board_refs(F.col("t"))).alias("b")).select("board_id", "b.key")


@query(
    """WITH b AS (SELECT board_id, board_id % 5 AS form, (board_id % 10000)::VARCHAR AS n FROM boards)
    SELECT board_id, CASE form WHEN 0 THEN 'SMDB' || n WHEN 1 THEN 'FACP' WHEN 2 THEN 'PANELB' || n WHEN 3 THEN 'MAINLVPANEL' ELSE 'DB0' || n END AS key, CASE form WHEN 0 THEN 'SMDB' WHEN 1 THEN 'FA' WHEN 2 THEN 'CTRL' WHEN 3 THEN 'MAIN' ELSE 'DB' END AS type,
      CASE WHEN form = 4 AND length(n) <= 2 THEN 'P' END AS section FROM b WHERE form != 4 OR length(n) <= 2 UNION ALL SELECT board_id, 'DB0' || n || 'P', 'DB', NULL FROM b WHERE form = 4 AND length(n) > 2"""
)
def typed_boards(spark: SparkSession, d: str) -> DataFrame:
    """Refs in single lines with type and section: spaced names, panels, alarm panels, the main panel, sections."""
    words = ("S M D B {n} at riser", "FACP {n} at door", "see Panel B{n}", "main switch board, MSB", "near DB-0{n}-P")
    n = {"n": F.col("board_id") % 10000}
    texts = table(spark, d, "boards").select("board_id", _case(F.col("board_id") % 5, *[_say(w, **n) for w in words]).alias("t"))
    return texts.select("board_id", F.explode(detect.line_boards(F.col("t"))).alias("b")).select("board_id", "b.key", "b.type", "b.section")


_LEGEND = (
    ("P1", "P1 - MCB Curve Type C", "MCB", "C", None), ("P2", "P2 - RCBO Type A 30 mA", "RCBO", None, 30), ("P3", "P3 - MCB / Fuse with RCD 30 mA", "MCB+RCD", None, 30), ("P4", "P4 - HRC Fuse", "Fuse", None, None),
    ("P5", "P5 - MCB as listed", "MCB", None, None), ("B", "B Fitted blank", None, None, None),
)
_LEGEND_ROWS = ", ".join(f"({k}, {q(code)}, {q(device) if device else 'NULL'}, {q(curve) if curve else 'NULL'}, {sens or 'NULL'}::DOUBLE)" for k, (code, _, device, curve, sens) in enumerate(_LEGEND))


@query(
    f"SELECT board_id, code, device, curve, sens, CASE WHEN (board_id >> k) % 2 = 1 THEN 'document_legend' ELSE 'legend' END AS source FROM boards, (VALUES {_LEGEND_ROWS}) v(k, code, device, curve, sens)"
)
def protection_legend(spark: SparkSession, d: str) -> DataFrame:
    """The legend that a page states in part, defaults for the rest: each board's page states the codes of the bits of its id."""
    said = [F.when(F.expr(f"shiftright(board_id, {k}) % 2 = 1"), text) for k, (_, text, *_) in enumerate(_LEGEND)]
    pages = table(spark, d, "boards").select("board_id", F.concat_ws("\n", F.lit("General"), *said).alias("t"))
    return pages.select("board_id", F.explode(parse.legend(F.col("t"))).alias("code", "v")).select("board_id", "code", "v.device", "v.curve", "v.sens", "v.source")


@query(
    f"""WITH {rendered.BASE}, {rendered._NUMBERED} SELECT file_id, page, line, {_LETTERS_OF} AS device, amps::DOUBLE AS rating, n::DOUBLE AS qty FROM lined WHERE n > 1"""
)
def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Devices named in specifications: each device of the table in a sentence, a quarter of them without rating and number."""
    named = F.when(F.col("device").isin(*rendered.NAMED), F.col("device")).otherwise("MCB")
    x = {"n": F.col("n"), "amps": F.col("amps"), "device": named, "descr": F.col("descr")}
    text = F.when(F.col("n") > 1, _say("supply {n} x {amps}A {device} to {descr}", **x)).otherwise(_say("provide {device} for {descr}", **x))
    lines = rendered.base(spark, d).select("file_id", "page", "rec_id", text.alias("text"))
    return parse.mentions(rendered.pages(lines).withColumn("page_type", F.lit("spec"))).select("file_id", "page", "line", "device", "rating", "qty")


@query(
    """WITH b AS (SELECT board_id, board_id % 4 AS form, (board_id % 98 + 2)::INTEGER AS w FROM boards) SELECT board_id, CASE WHEN form = 3 THEN w + 6 ELSE w END::INTEGER AS ways FROM b"""
)
def ways_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Ways that headers state, each board in one of four wordings; ``expected_ways`` reads the table's own texts."""
    x = {"w": F.col("board_id") % 98 + 2}
    words = ("{w} Way TPN board", "Ways: {w}", "No. of ways (SP): {w}", "{w}-Way Power + 6-Way Lighting")
    texts = table(spark, d, "boards").select("board_id", _case(F.col("board_id") % 4, *[_say(w, **x) for w in words]).alias("t"))
    return texts.select("board_id", detect.expected_ways(F.col("t"))["ways"].alias("ways"))


@query(f"WITH {rendered.BASE} SELECT file_id, page, count(*) >= 4 AS tabular FROM base GROUP BY 1, 2")
def tabular_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether pages written from the device table look like tables: with four rows or more."""
    lines = rendered.base(spark, d).select("file_id", "page", "rec_id", rendered.slash_lines().alias("text"))
    return rendered.pages(lines).select("file_id", "page", detect.looks_tabular(F.col("text")).alias("tabular"))


# --- texts of the tables, by the rules that the samples show ---------------------------------------------------------


#: A line that is a label and a ref of one or two words; longer ones are sentences.
_BOARD_LABEL = r"^\s*board\s+(?:reference|identity)\s*[:\-]?\s+(\S+(?: [^\s(]\S*)?)(?:\s*\(continued\))?\s*$"


def _device_texts(spark: SparkSession, d: str) -> DataFrame:
    """``rec_id, field_name, text``: the two texts of each device."""
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("device_class", "description")])
    return table(spark, d, "devices").select("rec_id", F.explode(fields).alias("f")).select("rec_id", "f.field_name", collapsed(F.col("f.text")).alias("text"))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "schedule_pages").where("text IS NOT NULL")
    return pages.select("file_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "text"))


_SAID = f"coalesce({got('u', detect.CURVE_WORDS[0])}, {got('u', detect.CURVE_WORDS[1])})"
_COMPACT = got("u", detect.CURVE_COMPACT.replace(r"(?=\s|$|[,;])", r"(?:\s|$|[,;])"))
_NEAR = "regexp_matches(u, '\\b(?:MCB|MCCB|RCBO|AFDD|CIRCUIT BREAKER)\\b')"
_REVISED = f"(regexp_matches(u, {q(detect.CURVE_REVISION)}) AND NOT regexp_matches(u, '\\b(?:MCB|MCCB|RCBO|AFDD)\\b'))"
_KA = f"try_cast({got('u', '\\b(\\d+(?:\\.\\d+)?)\\s*KA\\b')} AS DOUBLE)"


@query(
    f"""WITH f AS (SELECT rec_id, 'device_class' AS field_name, device_class AS x FROM devices UNION ALL SELECT rec_id, 'description', description FROM devices),
    t AS (SELECT rec_id, field_name, upper(trim(regexp_replace({t('x')}, '\\s+', ' ', 'g'))) AS u FROM f WHERE x IS NOT NULL),
    g AS (SELECT rec_id, field_name, coalesce({_SAID}, CASE WHEN {_NEAR} AND NOT {_REVISED} THEN {_COMPACT} END) AS curve, CASE WHEN {_KA} > 0 AND {_KA} <= 150 THEN {_KA} END AS ka FROM t)
    SELECT * FROM g WHERE curve IS NOT NULL OR ka IS NOT NULL"""
)
def device_curves(spark: SparkSession, d: str) -> DataFrame:
    """Tripping curves and breaking capacities that classes and descriptions of devices name; texts without either have no row."""
    found = _device_texts(spark, d).select("rec_id", "field_name", detect.tripping_curve(F.col("text"))["value"].alias("curve"), detect.breaking_capacity(F.col("text")).alias("ka"))
    return found.where("curve IS NOT NULL OR ka IS NOT NULL")


@query()
def page_board_refs(spark: SparkSession, d: str) -> DataFrame:
    """Refs of boards on pages by board key, once a page: what a line labels as its board, in any script; refs in other lines
    by the patterns, which know ASCII refs only."""
    plain = _page_lines(spark, d).withColumn("text", F.translate("text", *refs.plain_table()))
    label = first(F.col("text"), _BOARD_LABEL)
    lines = plain.withColumn("label", F.when(label.rlike(r"[\p{Nd}/-]"), label))
    labelled = lines.where("label IS NOT NULL").select("file_id", "page", refs.board_key(F.col("label")).alias("key")).where("key IS NOT NULL")
    other = lines.where("label IS NULL").select("file_id", "page", F.explode(detect.board_refs(F.col("text"))).alias("b")).select("file_id", "page", "b.key")
    return labelled.unionByName(other).distinct()


# --- pages ----------------------------------------------------------------------------------------------------------

_N_P = lambda p: f"len(regexp_extract_all(text, '{p}'))"


def _score_sql(core: bool) -> str:
    base = {k: [] for k in classify.TYPES}
    for kind, (by_codes, by_ways, pattern) in classify.SINGLE.items():
        base[kind].append(f"CASE WHEN regexp_matches(lower(text), {q(pattern)}) THEN {by_codes if core else by_ways} ELSE 0 END")
    base["legend"].append("CASE WHEN regexp_matches(lower(text), '\\blegend\\b') AND regexp_matches(lower(text), 'symbol|description|abbrev') THEN 5 ELSE 0 END")
    base["db-schedule"].append(f"CASE WHEN {_N_P('(?im)^\\s*(?:\\d{1,3}\\s+)?(?:L[123]\\s+)?\\d+(?:\\.\\d+)?\\s+[JKLMN]\\s+[BCD]\\b[^\\n]*\\b(?:Ri|Ra)\\s+[LP]\\b')} >= 2 AND {_N_P('\\bL[123]\\b')} >= 3 THEN 9 ELSE 0 END")
    if core:
        base["db-schedule"].append(f"CASE WHEN {_N_P('\\bP[1-5]\\b')} >= 4 AND {_N_P('\\bL[123]\\b')} >= 6 THEN 7 ELSE 0 END")
        rest = " + ".join(f"({' + '.join(v)})" for k, v in base.items() if v)
        base["cover"].append(f"CASE WHEN page = 1 AND page_count > 1 AND regexp_matches(lower(text), 'project|issued|revision') AND {rest} = 0 THEN 3 ELSE 0 END")
    else:
        ways = "len(regexp_extract_all(lower(text), '\\bway\\s*\\d+|\\bcct\\s*\\d+|\\bcircuit\\s*\\d+'))"
        base["db-schedule"] += [f"CASE WHEN {ways} >= 3 THEN 4 ELSE 0 END", "CASE WHEN regexp_matches(lower(text), 'board ref|board reference') THEN 2 ELSE 0 END"]
        base["cover"].append(f"CASE WHEN page = 1 AND page_count > 1 AND regexp_matches(lower(text), 'project|issued|revision') AND {ways} = 0 THEN 3 ELSE 0 END")
        base["register"].append("CASE WHEN page = 1 AND regexp_matches(lower(text), 'contents') THEN 2 ELSE 0 END")
    cols = {k: " + ".join(v) for k, v in base.items() if v}
    names = list(cols)
    best = f"greatest({', '.join(f's{i}' for i in range(len(names)))})"
    kind = "CASE WHEN best = 0 THEN 'unknown' " + " ".join(f"WHEN s{i} = best THEN {q(n)}" for i, n in enumerate(names)) + " END"
    step = 0.06 if core else 0.08
    return f"""SELECT file_id, page, {kind} AS kind, (CASE WHEN best = 0 THEN 0.3 ELSE round(least(0.97, 0.5 + best * {step}), 6) END)::DOUBLE AS confidence FROM (SELECT *, {best} AS best FROM (
      SELECT file_id, page, {', '.join(f'{c} AS s{i}' for i, c in enumerate(cols.values()))} FROM (SELECT file_id, page, page_count, coalesce(text, '') AS text FROM schedule_pages)))"""


def _typed(spark: SparkSession, d: str, core: bool) -> DataFrame:
    pages = table(spark, d, "schedule_pages")
    text = F.coalesce("text", F.lit(""))
    named = detect.has(text, "mccb|fuse|cable|connected from|connected to")  # only then the number of boards counts
    boards = F.when(named, F.size(detect.board_refs(text))) if core else None
    kind = classify.classified(text, F.col("page"), F.col("page_count"), boards, core)
    return pages.select("file_id", "page", kind.alias("k")).select("file_id", "page", "k.kind", "k.confidence")


@query(_score_sql(True))
def page_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of pages by the rules with protection codes."""
    return _typed(spark, d, True)


@query(_score_sql(False))
def page_types_by_ways(spark: SparkSession, d: str) -> DataFrame:
    """Types of pages by the rules with way counts."""
    return _typed(spark, d, False)


@query(
    """SELECT CASE WHEN page_type IN ('sld', 'schematic') THEN 'schematic' WHEN page_type IN ('db-schedule', 'main-schedule', 'cable-schedule', 'equipment-schedule') THEN 'db_schedule'
    WHEN page_type = 'spec' THEN 'specification' ELSE 'other' END AS kind, count(*) AS n_pages FROM schedule_pages GROUP BY 1"""
)
def three_types(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the three types."""
    return table(spark, d, "schedule_pages").groupBy(N.three_type(F.col("page_type")).alias("kind")).agg(F.count("*").alias("n_pages"))


_QUALITY = """m AS (SELECT id, kind, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS x FROM src),
  k AS (SELECT *, length(x) AS n, len(string_split(x, chr(10))) AS nl, len(regexp_extract_all(x, '[\\n\\t]|[^\\x00-\\x1F�]')) AS pr, len(regexp_extract_all(x, '[A-Za-z0-9]')) AS an,
    len(regexp_extract_all(x, '�')) AS bad, regexp_extract_all(x, '[A-Za-z0-9][A-Za-z0-9+&./-]*') AS tok,
    len(regexp_extract_all(x, '(?i)\\b(?:DB|BOARD|WAY|CIRCUIT|L[123]|MCB|MCCB|RCBO|RCD|AFDD|SPD|\\d+(?:\\.\\d+)?\\s*(?:A|MA|KA)|SPN|DPN|TPN)\\b')) AS sig FROM m),
  s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE round(greatest(0.0, least(1.0, 0.15::DOUBLE + least(0.25, n / 1200.0::DOUBLE) + least(0.12, nl / 30.0::DOUBLE) + pr / n::DOUBLE * 0.18 + least(0.1, len(tok) / 120.0::DOUBLE) + least(0.12, sig / 30.0::DOUBLE)
    + CASE WHEN pr / n::DOUBLE > 0.96 AND an / n::DOUBLE > 0.45 THEN 0.18 ELSE 0 END - least(0.45, bad / n::DOUBLE * 8) - CASE WHEN regexp_matches(coalesce(kind, ''), 'schedule|table') AND (n < 80 OR nl < 3) THEN 0.35 ELSE 0 END
    - CASE WHEN len(tok) > 0 AND len(list_filter(tok, lambda y: length(y) = 1)) / greatest(1, len(tok))::DOUBLE > 0.55 THEN 0.2 ELSE 0 END)), 6) END::DOUBLE AS score FROM k)"""


@query(f"WITH src AS (SELECT file_id || '|' || page AS id, page_type AS kind, text FROM schedule_pages), {_QUALITY} SELECT id, score, CASE WHEN score >= 0.62 AND pr / greatest(n, 1)::DOUBLE >= 0.9 AND bad = 0 THEN 'embedded_text' ELSE 'ocr' END AS route, sig::INTEGER AS signals FROM s")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of page texts, and how each is read."""
    pages = table(spark, d, "schedule_pages").select(F.concat_ws("|", "file_id", "page").alias("id"), quality.page_quality(F.col("text"), F.col("page_type")).alias("m"))
    return pages.select("id", "m.score", "m.route", "m.signals")


@query(f"WITH src AS (SELECT doc_id AS id, NULL AS kind, text FROM documents), {_QUALITY} SELECT id, score, nl::INTEGER AS lines FROM s")
def document_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of speeches by the same measures."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), quality.page_quality(F.col("text"), F.lit(None).cast("string")).alias("m"))
    return docs.select("id", "m.score", "m.lines")


@query("SELECT file_id, page, id, scale FROM (SELECT file_id, page, unnest(['base', 'enhanced'] || CASE WHEN least(width, height) < 800 THEN ['upscaled'] ELSE [] END) AS id, CASE WHEN least(width, height) < 800 THEN 3.0 ELSE 2.25 END::DOUBLE AS scale FROM schedule_pages WHERE NOT native)")
def reading_plan(spark: SparkSession, d: str) -> DataFrame:
    """Ways to render each page without a text layer."""
    none = F.lit(None).cast("double")
    plan = quality.reading_plan(F.col("width"), F.col("height"), F.lit(12.0), F.lit(0), none, none, none, F.lit(False))
    return table(spark, d, "schedule_pages").where("NOT native").select("file_id", "page", F.explode(plan).alias("c")).select("file_id", "page", "c.id", "c.scale")


_TRADE_WORDS = "(?i)\\b(?:MCB|MCCB|RCBO|RCD|AFDD|SPD|SPN|DPN|TPN|L[123]|\\d+(?:\\.\\d+)?\\s*(?:A|MA|KA))\\b"


@query(
    f"""WITH src AS (SELECT file_id || '|' || page AS id, page_type AS kind, text FROM schedule_pages), {_QUALITY},
    c AS (SELECT p.file_id, p.page, round(greatest(0.0, least(1.0, CASE WHEN native THEN 0.95 ELSE 0.7 END::DOUBLE * 0.45 + s.score * 0.42 + least(0.08, len(regexp_extract_all(coalesce(text, ''), '{_TRADE_WORDS}')) * 0.008)
      + least(0.05, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_matches(y, '(?:^|\\s)(?:\\d{{1,3}}\\s*(?:/\\s*)?L[123]|L[123]\\s+\\d+(?:\\.\\d+)?)', 'i'))) * 0.01))), 6)::DOUBLE AS score
      FROM schedule_pages p JOIN s ON s.id = p.file_id || '|' || p.page)
    SELECT file_id, page, score FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, page) = 1"""
)
def best_reading(spark: SparkSession, d: str) -> DataFrame:
    """The best page text of each file, the first in a tie."""
    pages = table(spark, d, "schedule_pages").withColumn("score", quality.candidate_score(F.col("text"), F.when(F.col("native"), 0.95).otherwise(0.7), F.col("page_type")))
    return pages.groupBy("file_id").agg(F.max_by(F.struct("page", "score"), F.struct("score", -F.col("page"))).alias("b")).select("file_id", "b.page", "b.score")


_NW = "try_cast(nullif(regexp_extract(ways_total, '{p}', 1, 'i'), '') AS INTEGER)"
_W1, _W2, _W3 = (_NW.format(p=p) for p in ("\\b(\\d{1,3})\\s*[- ]?WAYS?\\b", "\\bWAYS?\\s*[:=]\\s*(\\d{1,3})\\b", "\\bN(?:o|umber)\\.?\\s*of\\s*ways?\\s*(?:\\((?:SP|TP)\\))?\\s*[:=]?\\s*(\\d{1,3})"))


@query(f"SELECT board_id, CASE WHEN {_W1} BETWEEN 2 AND 200 THEN {_W1} WHEN {_W2} BETWEEN 2 AND 200 THEN {_W2} WHEN {_W3} BETWEEN 2 AND 200 THEN {_W3} END AS ways FROM boards WHERE ways_total IS NOT NULL")
def expected_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways that board headers state in words."""
    return table(spark, d, "boards").where("ways_total IS NOT NULL").select("board_id", detect.expected_ways(F.col("ways_total"))["ways"].alias("ways"))


@query()
def page_boards(spark: SparkSession, d: str) -> DataFrame:
    """The board each schedule page is about, from its own lines."""
    pages = table(spark, d, "schedule_pages").where("text IS NOT NULL")
    lines = pages.select("file_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw"), F.size(F.split("text", "\n")).alias("n_lines"))
    return parse.schedule_board(lines.withColumn("text", collapsed(F.col("raw"))), ["file_id", "page"])


@query(
    """SELECT file_id, page, (row_no - 1)::INTEGER AS row_no, array_to_string(list_filter(string_split(line, ' '), lambda w: w != ''), ' ') AS text FROM (
      SELECT file_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM schedule_pages WHERE text IS NOT NULL) WHERE trim(line) != ''"""
)
def spatial_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together again from the words of pages, placed where the text has them."""
    pages = table(spark, d, "schedule_pages").where("text IS NOT NULL")
    lines = pages.select("file_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("file_id", "page", "line", F.posexplode(F.split("t", " ")).alias("k", "text")).where("text != ''")
    x = F.col("k") * 60.0
    boxed = words.select("file_id", "page", "text", x.alias("x0"), (F.col("line") * 20.0).alias("y0"), (x + 50).alias("x1"), (F.col("line") * 20.0 + 10).alias("y1"), F.lit(90.0).alias("confidence"))
    return spatial.rows(boxed, ["file_id", "page"]).select("file_id", "page", "row_no", "text")


# --- fields ---------------------------------------------------------------------------------------------------------


_SEED_DEVICE = f"""CASE WHEN regexp_matches(u, '\\bAFDD\\b') AND regexp_matches(u, '\\bRCBO\\b') THEN 'AFDD+RCBO' WHEN regexp_matches(u, '\\bRCBO\\b') THEN 'RCBO' WHEN regexp_matches(u, '\\bMCCB\\b') THEN 'MCCB'
  WHEN regexp_matches(u, '\\bMCB\\b') THEN 'MCB' WHEN regexp_matches(u, '\\bRCD\\b') THEN 'RCD' WHEN regexp_matches(u, '\\b(?:HRC\\s+)?FUSE\\b') THEN 'FUSE' ELSE u END"""


@query(
    f"""WITH {READINGS}, n AS (SELECT *, {_SEED_DEVICE} AS seed_device FROM (SELECT *, upper(regexp_replace(device_text, '\\s+', ' ', 'g')) AS u FROM included))
    SELECT project_id, count(*) AS n_rows, sum(qty)::BIGINT AS quantity FROM n WHERE seed_device = 'MCB' AND rating = 16 GROUP BY 1"""
)
def seed_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows like the marked text ``16A MCB``, by project."""
    seed = spark.range(1).select(detect.seed(F.lit("16A MCB")).alias("s")).select("s.device", "s.rating")
    rows = R.included(R.readings(table(spark, d, "devices"))).withColumn("device", N.assisted_device(F.col("device_text")))
    hits = rows.join(F.broadcast(seed), ["device", "rating"], "left_semi")  # the seed is one row
    return hits.groupBy("project_id").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("quantity"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def coerced_json(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of JSON texts whose fields are all strings; unreadable ones are null."""
    read = F.from_json("props", "k string", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", F.nullif(read["k"], F.lit("")).try_cast("double").alias("k"))


@query(
    f"""SELECT board_id, regexp_replace(display, '[\\s._/\\\\-]+', '', 'g') AS norm, display, section FROM (SELECT board_id, CASE WHEN ok THEN stem ELSE shown END AS display, CASE WHEN ok THEN regexp_extract(shown, '-(LP|L|P)$', 1) END AS section
      FROM (SELECT *, regexp_extract(shown, '^(DB(?:-[A-Z0-9]+)+)-(LP|L|P)$', 1) AS stem, regexp_matches(regexp_extract(shown, '^(DB(?:-[A-Z0-9]+)+)-(LP|L|P)$', 1), '-\\d{{1,3}}$') AS ok FROM (
      SELECT board_id, regexp_replace(regexp_replace(regexp_replace(upper({t('ref')}), '\\s*[._/\\\\-]\\s*', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS shown FROM boards)))"""
)
def canonical_boards(spark: SparkSession, d: str) -> DataFrame:
    """Board refs with one separator, the section split off."""
    return table(spark, d, "boards").select("board_id", N.canonical_board(F.col("ref")).alias("c")).select("board_id", "c.norm", "c.display", "c.section")


@query(f"SELECT file_id, trim(regexp_replace(regexp_replace({t('file_name')}, '[<>:\"/\\\\|?*]+', '-', 'g'), '\\s+', ' ', 'g')) AS name FROM files")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """File names that any file system takes."""
    return table(spark, d, "files").select("file_id", F.trim(N.safe_file_name(F.col("file_name"))).alias("name"))


_CAP = got(f"replace({t('fault_ka')}, ',', '.')", "(\\d+(?:\\.\\d+)?)")


@query(f"SELECT board_id, CASE WHEN upper({t('fault_ka')}) IN ('', 'NOT SPECIFIED') THEN 'Not specified' WHEN {_CAP} IS NULL THEN replace({t('fault_ka')}, ',', '.') ELSE regexp_replace(regexp_replace(printf('%.2f', {_CAP}::DOUBLE), '0+$', ''), '\\.$', '') || 'kA' END AS capacity FROM boards")
def breaking_capacities(spark: SparkSession, d: str) -> DataFrame:
    """Fault levels as capacities."""
    return table(spark, d, "boards").select("board_id", N.breaking_capacity(F.col("fault_ka")).alias("capacity"))
