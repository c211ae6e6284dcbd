"""Sinks of reports. A report is small (lines by boards); it is written to the driver's disk, row by row, never gathered in
pandas, and refused beyond ``MOST_ROWS``: larger results are written with ``df.write``. Nothing is written unless the totals
reconcile."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from tallyforge.operators.consolidate import assert_reconciled


#: Rows of a sheet that a reader can open.
MOST_ROWS = 1_000_000


class TooLong(ValueError):
    """More rows than a report may have; nothing was written."""


def _refuse_long(*sheets: DataFrame) -> None:
    for df in sheets:
        if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise TooLong(f"more than {MOST_ROWS} rows")


def csv_cell(value: object) -> str:
    s = "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in '",\r\n') else s


def csv_text(header: list[str], rows: Iterable[tuple]) -> str:
    """Byte order mark, CRLF between lines, none at the end; quotes only where needed."""
    return "﻿" + "\r\n".join(",".join(map(csv_cell, r)) for r in (header, *rows))


def write_csv(report: DataFrame, issues: DataFrame, path: str) -> None:
    assert_reconciled(issues)
    _refuse_long(report)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(csv_text(report.columns, (tuple(r) for r in report.toLocalIterator())))


def column_name(n: int) -> str:
    """A, B, ... Z, AA of the column number from 1 on."""
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cells(rows: Iterable[tuple]) -> Iterator[str]:
    for i, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row, 1):
            at = f"{column_name(k)}{i}"
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        yield f'<row r="{i}">{"".join(cells)}</row>'


def write_workbook(sheets: dict[str, DataFrame], issues: DataFrame, path: str) -> None:
    """An XLSX file with one sheet a DataFrame, streamed into the archive."""
    assert_reconciled(issues)
    _refuse_long(*sheets.values())
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in n) + "</Types>")  # fmt: skip
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(s[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="s{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                rows = (tuple(r) for r in df.toLocalIterator())
                for cell in _cells(r for part in ([tuple(df.columns)], rows) for r in part):
                    f.write(cell.encode())
                f.write(b"</sheetData></worksheet>")
