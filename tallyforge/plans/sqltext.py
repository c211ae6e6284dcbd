"""Pieces of SQL for the twins of queries."""

from __future__ import annotations

from tallyforge.functions import normalise as N
from tallyforge.functions.patterns import BLANKS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def t(c: str) -> str:
    return f"coalesce(trim(translate({c}, {q(BLANKS)}, {q(' ' * len(BLANKS))})), '')"


def rule(c: str, rules, otherwise: str = "NULL", options: str = "i") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(p)}, '{options}') THEN {q(n)}" for n, p in rules) + f" ELSE {otherwise} END"


def got(c: str, pattern: str, group: int = 1, options: str = "i") -> str:
    return f"nullif(regexp_extract({c}, {q(pattern)}, {group}, '{options}'), '')"


def device(c: str) -> str:
    raw = f"upper({t(c)})"
    for pattern, short in N.LONG_NAMES:
        raw = f"regexp_replace({raw}, {q(pattern)}, '{short}', 'g')"
    raw = f"regexp_replace(trim(regexp_replace({raw}, '[^A-Z0-9+]+', ' ', 'g')), 'S$', '')"
    table = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in N.DEVICE_FAMILIES.items())
    return f"coalesce(CASE {raw} {table} END, CASE replace({raw}, ' ', '') {table} END, nullif({t(c)}, ''), 'Other device')"


def group(c: str) -> str:
    return "CASE " + " ".join(f"WHEN upper({c}) IN ({', '.join(map(q, m))}) THEN {q(g)}" for g, m in N.GROUPS.items() if m) + " ELSE 'Other Devices' END"


def places(n: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.2f', {n}), '0+$', ''), '\\.$', '')"


_POLE = f"regexp_replace(replace(upper({t('poles')}), '.', ''), '\\s+', ' ', 'g')"
_CURVE = f"upper({t('trip_curve')})"
_CONF = "regexp_extract(replace({c}, ',', '.'), '^([0-9]*\\.?[0-9]+)\\s*%?$', 1)".format(c=t("confidence"))

#: CTE ``readings``, the normalised device rows.
READINGS = f"""readings AS MATERIALIZED (SELECT *, upper(device_text) IN ('SPACE', 'BLANK') AS space, CASE WHEN upper(device_text) IN ('SPACE', 'BLANK') THEN 0 ELSE 1 END::BIGINT AS qty,
    {group('device')} AS grp FROM (
  SELECT rec_id, project_id, file_id, page, received_at, regexp_replace(upper({t('board_ref')}), '[\\s._/-]+', '', 'g') AS board,
    try_cast({got('way', '^\\s*(?:way|w|cct|ckt|circuit)?[\\s.:#]*0*([0-9]{1,9})(?:\\.0+)?\\s*$')} AS INTEGER) AS way, upper({t('phase')}) AS phase,
    {t('device_class')} AS device_text, {device('device_class')} AS device,
    CASE WHEN try_cast({got(f"replace({t('rating_a')}, ',', '.')", '(\\d+(?:\\.\\d+)?)')} AS DOUBLE) > 0 THEN try_cast({got(f"replace({t('rating_a')}, ',', '.')", '(\\d+(?:\\.\\d+)?)')} AS DOUBLE) END AS rating,
    CASE WHEN {_CURVE} IN ('', 'NOT SPECIFIED') THEN 'Not specified' ELSE coalesce({got(_CURVE, '^([BCDKZ])\\s*[- ]?\\s*\\d+(?:\\.\\d+)?\\s*A?$')},
      {got(_CURVE, '\\b(?:(?:TYPE|CURVE|CHARACTERISTIC)\\s*[-:]?\\s*)?([BCDKZ])(?:\\s*[- ]?CURVE)?\\b')}, {_CURVE}) END AS curve,
    {rule(_POLE, N.POLE_WORDS, f"CASE WHEN upper({t('phase')}) IN ('3PH', 'L1L2L3') THEN 'TPN' ELSE 'Unclear' END")} AS pole,
    {t('description')} AS description, {rule(f"lower({t('description')})", N.PURPOSE_WORDS, q(N.GENERAL))} AS purpose,
    coalesce(try_cast({_CONF} AS DOUBLE) / CASE WHEN confidence LIKE '%\\%%' ESCAPE '\\' THEN 100 ELSE 1 END, 0) AS conf, coalesce(is_incomer, false) AS incomer
  FROM devices)),
  included AS (SELECT *, concat_ws('|', project_id, board) AS board_id FROM readings WHERE device_text != '' AND NOT space)"""
