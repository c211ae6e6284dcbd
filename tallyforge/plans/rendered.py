"""Schedule lines written from the device, board and feed tables in every layout, to be read back by the parsers.

Each row of a table is written once in each layout; lines of a page stand in the order of their ids. What must come back
is known from the table, so the SQL twins never look at a text. Descriptions are kept as letters; those with words that
mean something to a grammar are written as ``general load``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.patterns import first
from tallyforge.plans import parse
from tallyforge.plans import report as R
from tallyforge.plans.sqltext import READINGS, q
from tallyforge.runtime import table

#: Words that a grammar reads as something else than a description.
RESERVED = (
    r"\b(?:mcbs?|rcbos?|mccbs?|acbs?|rcds?|rccbs?|afdd|affd|spds?|surge|fuses?|hrc|isolators?|switch|disconnectors?|contactors?|clock|timeclock|photocell|relays?|timers?|starters?"
    r"|overloads?|transformers?|dali|meters?|spare|space|blank|incomer|incoming|main|way|ways|circuit|cct|ckt|description|rating|device|protect|protection|cable|phase|poles?|cpc|earth|curve|type"
    r"|rad|ring|lighting|fixed|power|note|notes|nb|remark|remarks|tbc|tbd|guess|unknown|single|double|triple|three|four|sp|dp|tp|tpn|neutral|are)\b"
)
#: Families by upper name and what stands for them: code in the full code, code in the list.
FULL = {"MCCB": "J", "MCB": "K", "FUSE": "L", "RCBO": "M", "AFDD+RCBO": "N"}
LISTED = {"MCB": "P1", "RCBO": "P2", "AFDD+RCBO": "P2", "RCD": "P3", "FUSE": "P4", "MCCB": "P5"}
#: Device families that a sentence may name; others are written as MCB.
NAMED = ("AFDD+RCBO", "RCBO", "MCCB", "ACB", "MCB", "RCD")


def base(spark: SparkSession, d: str) -> DataFrame:
    """Readings of devices with every field that a line shows filled in."""
    rows = R.readings(table(spark, d, "devices"))
    raw = table(spark, d, "devices").select("rec_id", first(F.col("rcd_ma"), r"^(\d+)").alias("ma"), F.col("cpc_csa_mm2").alias("csa_text"))
    letters = F.trim(F.regexp_replace(F.lower("description"), "[^a-z]+", " "))
    plain = F.when(letters.rlike(RESERVED) | (letters == ""), "general load").otherwise(F.concat(F.lit("load "), letters))
    id_ = F.col("rec_id")
    return rows.join(raw, "rec_id").select(
        "rec_id", "file_id", "page", F.when(F.col("way").between(1, 999), F.col("way")).otherwise(id_ % 60 + 1).cast("int").alias("way"),
        F.when(F.col("phase").isin("L1", "L2", "L3"), F.col("phase")).otherwise(F.concat(F.lit("L"), (id_ % 3 + 1).cast("string"))).alias("phase"),
        F.least(F.coalesce(F.ceil("rating"), F.lit(16)), F.lit(999)).cast("int").alias("amps"), F.when(F.col("curve").isin("B", "C", "D"), F.col("curve")).otherwise("C").alias("curve"), "device",
        F.col("ma").cast("int").alias("ma"), F.coalesce(first(F.col("csa_text"), r"^(\d+(?:\.\d+)?)$"), F.lit("2.5")).alias("csa"), (id_ % 2 == 0).alias("ring"), (id_ % 4 + 1).cast("int").alias("n"),
        (F.col("pole").isin("TPN", "TP")).alias("three"), plain.alias("descr"),
    )


#: CTE ``base``, the same in SQL.
BASE = f"""{READINGS},
  base AS MATERIALIZED (SELECT rec_id, file_id, page, CASE WHEN way BETWEEN 1 AND 999 THEN way ELSE rec_id % 60 + 1 END::INTEGER AS way, CASE WHEN phase IN ('L1', 'L2', 'L3') THEN phase ELSE 'L' || (rec_id % 3 + 1) END AS phase,
    least(coalesce(ceil(rating), 16), 999)::INTEGER AS amps, CASE WHEN curve IN ('B', 'C', 'D') THEN curve ELSE 'C' END AS curve, device, ma, csa, rec_id % 2 = 0 AS ring, (rec_id % 4 + 1)::INTEGER AS n, pole IN ('TPN', 'TP') AS three,
    CASE WHEN regexp_matches(letters, {q(RESERVED)}) OR letters = '' THEN 'general load' ELSE 'load ' || letters END AS descr
    FROM (SELECT r.*, try_cast(nullif(regexp_extract(d.rcd_ma, '^(\\d+)', 1), '') AS INTEGER) AS ma, coalesce(nullif(regexp_extract(d.cpc_csa_mm2, '^(\\d+(?:\\.\\d+)?)$', 1), ''), '2.5') AS csa,
      trim(regexp_replace(lower(r.description), '[^a-z]+', ' ', 'g')) AS letters FROM readings r JOIN devices d USING (rec_id)))"""


def pages(lines: DataFrame, head: list[str] | None = None) -> DataFrame:
    """``file_id, page, page_type, text`` of ``file_id, page, rec_id, text`` (a row may be several lines); a page is as small as in the table."""
    body = F.array_sort(F.collect_list(F.struct("rec_id", "text")))
    whole = lines.groupBy("file_id", "page").agg(F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("text"))
    start = [F.lit(x) for x in head or []]
    return whole.select("file_id", "page", F.lit("db-schedule").alias("page_type"), F.concat_ws("\n", *start, "text").alias("text"))


def pick(c: Column, table_: dict[str, str], otherwise: str) -> Column:
    out = None
    for k, v in table_.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(otherwise)


def sql_pick(c: str, table_: dict[str, str], otherwise: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table_.items()) + f" ELSE {q(otherwise)} END"


# --- layouts --------------------------------------------------------------------------------------------------------


def _join(*cells: Column) -> Column:
    return F.concat_ws(" ", *cells)


def _cells() -> dict[str, Column]:
    """What lines show, by name."""
    c = F.col
    return {
        "spare": F.upper("device") == "SPARE", "space": F.upper("device").isin("SPACE", "BLANK"), "slot": F.concat_ws("/", "way", "phase"), "ma": F.coalesce(c("ma").cast("string"), F.lit("-")),
        "afdd": F.when(c("device") == "AFDD+RCBO", "YES").otherwise("NO"), "kind": F.when(c("ring"), "RING").otherwise("RAD"), "amps": c("amps").cast("string"), "way": c("way").cast("string"),
    }


def slash_lines() -> Column:
    x = _cells()
    full = _join(x["slot"], x["amps"], F.col("curve"), x["ma"], x["afdd"], F.lit("3"), F.col("csa"), F.lit("1.5"), x["kind"], F.col("descr"))
    return F.when(x["spare"], _join(x["slot"], F.lit("spare"))).otherwise(full)


def service_lines() -> Column:
    x = _cells()
    return _join(x["slot"], x["amps"], F.col("csa"), F.lit("SWA"), F.lit("XLPE"), F.when(F.col("ring"), "Lighting").otherwise("Fixed power"), F.col("descr"))


def text_first_lines() -> Column:
    x = _cells()
    return _join(x["way"], F.col("phase"), F.col("descr"), x["kind"], x["amps"], F.col("curve"), x["ma"], x["afdd"])


def plain_lines() -> Column:
    x = _cells()
    full = _join(x["way"], F.col("descr"), x["amps"], F.col("curve"), x["ma"], F.col("csa"), F.lit("3"), F.lit("1.5"))
    return F.when(x["spare"], _join(x["way"], F.lit("Spare 0"))).otherwise(full)


def listed_lines() -> Column:
    """The way is left out where the phase goes on from the line before."""
    x, rank = _cells(), F.substring("phase", 2, 1)
    goes_on = F.coalesce(rank > F.lag(rank).over(Window.partitionBy("file_id", "page").orderBy("rec_id")), F.lit(False))
    full = _join(x["amps"], pick(F.upper("device"), LISTED, "P1"), F.col("descr"), F.col("csa"), F.lit("T1 1,3"))
    return _join(F.when(~goes_on, x["way"]), F.col("phase"), F.when(x["space"], "B empty slot").otherwise(full))


#: Lines at the top of each page in the full code.
CODED_HEAD = ["Board Reference: DB-1", "999 L1 6 K B 10 Ra L A 3 1.5 1.5 W N N/A N indicator"]


def coded_lines() -> Column:
    """Single circuits with the phase on a line of its own; three-pole, spare and blank ways over three lines."""
    x = _cells()
    code = pick(F.upper("device"), FULL, "K")
    tail = _join(F.when(F.col("ma").isNotNull(), x["ma"]), F.lit("10"), F.when(F.col("ring"), "Ri").otherwise("Ra"), F.lit("P A 3"), F.col("csa"), F.lit("1.5 W N N/A N"), F.col("descr"))
    over = lambda *cells: F.concat_ws("\n", *cells)
    single = over(_join(x["way"], x["amps"], code, F.col("curve"), tail), F.col("phase"))
    three = over(_join(x["way"], F.lit("L1"), x["amps"], code, F.col("curve"), tail), F.lit("L2"), F.lit("L3"))
    empty = lambda second: over(_join(x["way"], F.lit("L1")), F.lit(second), F.lit("L3"))
    return F.when(x["spare"], empty("L2 spare")).when(x["space"], empty("L2")).when(F.col("three"), three).otherwise(single)


def sentences() -> Column:
    x = _cells()
    named = F.when(F.col("device").isin(*NAMED), F.col("device")).otherwise("MCB")
    return _join(
        F.lit("Way"), x["way"], F.col("n").cast("string"), F.lit("x"), F.concat(x["amps"], F.lit("A")), named, F.lit("Type"), F.col("curve"), F.concat(F.col("n").cast("string"), F.lit("P")), F.col("phase"),
        F.concat(F.coalesce("ma", F.lit(30)).cast("string"), F.lit("mA")), F.concat(F.col("n") * 6, F.lit("kA")), F.col("descr"),
    )


LAYOUTS = {"slash": slash_lines, "service": service_lines, "text_first": text_first_lines, "plain": plain_lines, "listed": listed_lines, "coded": coded_lines, "sentences": sentences}
COLUMNS = ["file_id", "page", "line", *parse.FIELDS]


def read_back(spark: SparkSession, d: str, layout: str) -> DataFrame:
    """Rows that the parsers find on the pages of a layout."""
    lines = base(spark, d).select("file_id", "page", "rec_id", LAYOUTS[layout]().alias("text"))
    return parse.parse_pages(pages(lines, CODED_HEAD if layout == "coded" else None)).select(*COLUMNS)


_SQL_TYPES = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
_LINE = "(row_number() OVER (PARTITION BY file_id, page ORDER BY rec_id) - 1)::INTEGER"


def _expected(source: str, line: str = "line", where: str = "", **have: str) -> str:
    """SQL of a row for each line: the fields given, defaults for the others."""
    default = {"poles": "1", "spare": "false", "space": "false", "qty": "1", "review": "false"}
    cells = ", ".join(f"({(default | have).get(k, 'NULL')})::{_SQL_TYPES[t]} AS {k}" for k, t in parse.FIELDS.items())
    return f"SELECT file_id, page, {line} AS line, {cells} FROM {source} {where}"


_NUMBERED = f"lined AS MATERIALIZED (SELECT *, {_LINE} AS line, upper(device) = 'SPARE' AS is_spare, upper(device) IN ('SPACE', 'BLANK') AS is_space FROM base)"
_PROTECTED = "CASE WHEN ma > 0 THEN 'RCBO' ELSE 'MCB' END"
_AFDD = f"CASE WHEN device = 'AFDD+RCBO' THEN 'AFDD+RCBO' ELSE {_PROTECTED} END"
_RING = "CASE WHEN ring THEN 'ring' ELSE 'radial' END"
_SPARE = {"descr": "'Spare'", "spare": "true", "qty": "0", "conf": "0.96", "dialect": "'spare'", "way": "way"}
_CODE = "CASE code WHEN 'P1' THEN {} WHEN 'P2' THEN {} WHEN 'P3' THEN {} WHEN 'P4' THEN {} WHEN 'P5' THEN {} END"
_ROWS_OF_CODE = f"""counted AS (SELECT *, CASE WHEN is_spare OR is_space OR three THEN 3 ELSE 2 END AS n_lines, {sql_pick('upper(device)', FULL, 'K')} AS code FROM lined),
  placed AS MATERIALIZED (SELECT *, (2 + coalesce(sum(n_lines) OVER (PARTITION BY file_id, page ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS first_row FROM counted)"""
_CODED_DEVICE = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parse.CODED.items()) + " END"
SQL = {
    "slash": f"WITH {BASE}, {_NUMBERED} "
    + _expected("lined", where="WHERE NOT is_spare", way="way", phase="phase", rating="amps", device=_AFDD, curve="curve", sens="ma", config=_RING, csa="csa", cpc="'1.5'", descr="descr", conf="0.94", dialect="'slash columns'")
    + " UNION ALL " + _expected("lined", where="WHERE is_spare", phase="phase", **_SPARE),
    "service": f"WITH {BASE}, {_NUMBERED} "
    + _expected("lined", way="way", phase="phase", rating="amps", device="CASE WHEN ring THEN 'MCB' ELSE 'RCBO' END", sens="CASE WHEN NOT ring THEN 30 END", csa="csa", cpc="'SWA'", descr="CASE WHEN ring THEN 'Lighting ' ELSE 'Fixed power ' END || descr", conf="0.9", dialect="'service columns'"),
    "text_first": f"WITH {BASE}, {_NUMBERED} "
    + _expected("lined", way="way", phase="phase", rating="amps", device=_AFDD, curve="curve", sens="ma", config=_RING, descr="descr", conf="0.93", dialect="'text first'"),
    "plain": f"WITH {BASE}, {_NUMBERED} "
    + _expected("lined", where="WHERE NOT is_spare", way="way", rating="amps", device=_PROTECTED, curve="curve", sens="ma", csa="csa", cpc="'1.5'", descr="descr", conf="0.91", dialect="'no phase'")
    + " UNION ALL " + _expected("lined", where="WHERE is_spare", **_SPARE),
    "listed": f"""WITH {BASE}, {_NUMBERED}, coded AS (SELECT *, {sql_pick('upper(device)', LISTED, 'P1')} AS code, coalesce(phase > lag(phase) OVER (PARTITION BY file_id, page ORDER BY rec_id), false) AS goes_on FROM lined),
    filled AS (SELECT *, last_value(CASE WHEN NOT goes_on THEN way END IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY rec_id ROWS UNBOUNDED PRECEDING) AS shown FROM coded) """
    + _expected("filled", where="WHERE NOT is_space", way="shown", phase="phase", rating="amps", device=_CODE.format("'MCB'", "'RCBO'", "'MCB+RCD'", "'Fuse'", "'MCB'"), curve="CASE code WHEN 'P1' THEN 'C' END", sens="CASE WHEN code IN ('P2', 'P3') THEN 30 END",
        csa="csa", descr="descr", conf="0.86", dialect="'coded list'", review="code = 'P5'")
    + " UNION ALL " + _expected("filled", where="WHERE is_space", way="shown", phase="phase", descr="'empty slot'", space="true", qty="0", conf="0.86", dialect="'coded list'", review="true"),
    "coded": f"WITH {BASE}, {_NUMBERED}, {_ROWS_OF_CODE} "
    + _expected("placed", "first_row", "WHERE NOT is_spare AND NOT is_space", way="way", phase="CASE WHEN three THEN '3PH' ELSE phase END", rating="amps", device=_CODED_DEVICE, curve="curve", sens="ma", ka="10", poles="CASE WHEN three THEN 3 ELSE 1 END", config=_RING, csa="csa", cpc="'1.5'",
        descr="descr", conf="0.98", dialect="'full code'")
    + " UNION ALL " + _expected("placed", "CASE WHEN is_spare THEN first_row + 1 ELSE first_row END", "WHERE is_spare OR is_space", way="way", descr="CASE WHEN is_spare THEN 'Spare' ELSE 'Space' END", spare="is_spare", space="is_space", qty="0", conf="0.98", dialect="'full code'")
    + " UNION ALL " + _expected("(SELECT DISTINCT file_id, page FROM base)", "1::INTEGER", way="999", phase="'L1'", rating="6", device="'MCB'", curve="'B'", ka="10", config="'radial'", csa="'1.5'", cpc="'1.5'", descr="'indicator'", conf="0.98", dialect="'full code'"),
    "sentences": f"WITH {BASE}, {_NUMBERED}, named AS (SELECT *, CASE WHEN device IN ({', '.join(map(q, NAMED))}) THEN device ELSE 'MCB' END AS family FROM lined) "
    + _expected("named", way="way", phase="phase", rating="amps", device="family", curve="curve", sens="coalesce(ma, 30)", ka="n * 6", poles="n", qty="n", conf="0.75", dialect="'generic'",
        descr="n || ' x ' || amps || 'A ' || family || ' Type ' || curve || ' ' || n || 'P ' || phase || ' ' || coalesce(ma, 30) || 'mA ' || n * 6 || 'kA ' || descr"),
}


# --- descriptions that name equipment -----------------------------------------------------------------------------------


def with_equipment(rows: DataFrame) -> DataFrame:
    """Readings whose descriptions go on with equipment: so many contactors, a time clock, so many photocells, or none."""
    n = (F.col("rec_id") % 9 + 1).cast("string")
    form = F.col("rec_id") % 4
    more = F.when(form == 0, F.concat(F.lit(" with "), n, F.lit(" x contactors"))).when(form == 1, " and time clock").when(form == 2, F.concat(F.lit(" via "), n, F.lit(" x photocells"))).otherwise("")
    return rows.withColumn("description", F.concat("description", more))


#: CTE ``equipped``: what these descriptions name, known from the ids.
EQUIPPED = """equipped AS MATERIALIZED (SELECT rec_id, board_id, conf, CASE rec_id % 4 WHEN 0 THEN 'Contactor' WHEN 1 THEN 'Time clock' ELSE 'Photocell' END AS named, CASE WHEN rec_id % 4 = 1 THEN 1 ELSE rec_id % 9 + 1 END::DOUBLE AS n
  FROM included WHERE upper(device) IN ('MCB', 'RCBO', 'AFDD+RCBO', 'MCCB', 'ACB', 'RCD', 'FUSE') AND rec_id % 4 != 3)"""
