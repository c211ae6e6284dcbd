"""One consistent form for text that looks the same but differs in its characters.

Each Arrow partition is handled by an in-process DuckDB: embedded SQL maps styled forms, blanks, dashes and invisible
characters with translate, finds the script of the letters that have no double by regular expressions, maps look-alike
letters to it and composes accents with nfc_normalize. Only texts with characters beyond plain ASCII go through the
tables, and each distinct text of a batch once. Nothing is shuffled.

Defined results: null stays null, an empty text stays empty; blanks at the ends go, those within become spaces and keep
their number; order and number of rows stay. Of a text with letters of several scripts that have no double, the script
with most of them wins, Latin, then Cyrillic, in a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import refs as R

_PLAIN = "[ -~]*"


def _class(chars: list[str]) -> str:
    """A regular-expression class of characters, in runs."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in runs) + "]"


def _sql() -> str:
    q = R._q
    source, target = R.plain_table()
    pairs = list(zip(source, target))
    blanks, dashes = [c for c, t in pairs if t == " "], [c for c, t in pairs if t == "-"]
    styled = [(c, t) for c, t in pairs if t not in " -"]
    table = f"{q(''.join(c for c, _ in styled))}, {q(''.join(t for _, t in styled))}"
    # one pass of a compiled expression for each class; the large table only where a styled form is there
    plain = "raw"
    for chars, new in ((list(source[len(target) :]), ""), (blanks, " "), (dashes, "-")):
        plain = f"regexp_replace({plain}, {q(_class(chars))}, '{new}', 'g')"
    counts = ", ".join(f"len(regexp_extract_all(plain, {q('[' + R.anchors(s) + ']')})) AS {s}" for s in R.SCRIPTS)
    form = {s: f"translate(plain, {q(R.lookalike_table(s)[0])}, {q(R.lookalike_table(s)[1])})" for s in R.SCRIPTS}
    return f"""
    WITH texts AS MATERIALIZED (SELECT DISTINCT raw FROM batch WHERE raw IS NOT NULL),
    swept AS MATERIALIZED (
      SELECT raw, CASE WHEN regexp_full_match(raw, '{_PLAIN}') THEN raw ELSE {plain} END AS clean FROM texts),
    plains AS MATERIALIZED (
      SELECT raw, CASE WHEN regexp_matches(clean, {q(_class([c for c, _ in styled]))}) THEN translate(clean, {table}) ELSE clean END AS plain FROM swept),
    scripts AS MATERIALIZED (
      SELECT raw, plain, {counts} FROM plains WHERE NOT regexp_full_match(plain, '{_PLAIN}')),
    forms AS (
      SELECT raw, CASE WHEN cyrillic > latin AND cyrillic >= greek THEN {form['cyrillic']}
        WHEN greek > latin AND greek > cyrillic THEN {form['greek']} ELSE {form['latin']} END AS form FROM scripts
      UNION ALL SELECT raw, plain FROM plains WHERE regexp_full_match(plain, '{_PLAIN}')),
    done AS (SELECT raw, trim(nfc_normalize(form)) AS form FROM forms)
    SELECT done.form FROM batch LEFT JOIN done ON batch.raw = done.raw ORDER BY batch.place"""


def consistent(df: DataFrame, text: str, out: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``out``, the consistent form of ``text``."""
    ddl = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        sql = _sql()
        for batch in batches:
            raw = batch.column("_raw")
            con.register("batch", pa.table({"raw": raw.cast(pa.string()), "place": pa.array(range(len(raw)), pa.int64())}))
            got = con.sql(sql).to_arrow_table()["form"]
            got = pa.concat_arrays(got.chunks).cast(pa.string()) if got.num_chunks else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [got], [*keep, out])
            con.unregister("batch")

    return df.select(*keep, F.col(text).alias("_raw")).mapInArrow(run, f"{ddl}`{out}` string")
