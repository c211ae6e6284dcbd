"""Weighted rules that tell the type of a page: weights of the rules that hold are summed by type; the best sum wins, and in
a tie the type whose first rule comes first. The rules are a table, read by one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.patterns import count, has

_CODED = r"(?m)^\s*(?:\d{1,3}\s+)?(?:L[123]\s+)?\d+(?:\.\d+)?\s+[JKLMN]\s+[BCD]\b[^\n]*\b(?:Ri|Ra)\s+[LP]\b"
_PHASE, _CODE = r"(?-i:\bL[123]\b)", r"(?-i:\bP[1-5]\b)"
_WAY = r"\bway\s*\d+|\bcct\s*\d+|\bcircuit\s*\d+"
_ISSUE = "project|issued|revision"
#: Fixed values: (type, weight where protection codes count, weight where ways count, patterns with the least number of
#: matches each (0: none may match), condition beside the text).
RULES = (
    ("register", 8, 8, {r"drawing register|drawing list|drawing index|dwg register": 1}, ""),
    ("legend", 5, 5, {r"\blegend\b": 1, "symbol|description|abbrev": 1}, ""),
    ("lighting-plan", 5, 5, {r"lighting (?:layout|plan|drawing)": 1}, ""),
    ("power-plan", 5, 5, {r"small.?power|power (?:layout|plan)": 1}, ""),
    ("fire-plan", 5, 5, {r"fire.?alarm (?:layout|plan|drawing)|fire detection layout": 1}, ""),
    ("containment-plan", 5, 5, {r"containment|cable tray layout|trunking layout|basket layout": 1}, ""),
    ("sld", 4, 4, {r"single.?line|schematic|busbar|incoming supply|main switchboard": 1}, ""),
    ("db-schedule", 7, 6, {r"distribution board schedule|board schedule|db schedule": 1}, ""),
    ("main-schedule", 7, 6, {r"main (?:panel|lv panel|switch\s?board).{0,30}schedule": 1}, ""),
    ("cable-schedule", 7, 6, {r"cable schedule": 1}, ""),
    ("equipment-schedule", 7, 6, {r"equipment schedule": 1}, ""),
    ("spec", 3, 3, {r"specification|shall be provided|shall comply|bs 7671|clause": 1}, ""),
    ("notes", 4, 4, {r"general notes|electrical notes": 1}, ""),
    ("db-schedule", 7, 0, {_CODE: 4, _PHASE: 6}, ""),
    ("db-schedule", 0, 4, {_WAY: 3}, ""),
    ("db-schedule", 0, 2, {"board ref|board reference": 1}, ""),
    ("db-schedule", 9, 9, {_CODED: 2, _PHASE: 3}, ""),
    ("sld", 5, 0, {"mccb|fuse|cable|connected from|connected to": 1}, "three boards"),
    ("cover", 3, 0, {_ISSUE: 1}, "first of many, alone"),
    ("cover", 0, 3, {_ISSUE: 1, _WAY: 0}, "first of many"),
    ("register", 0, 2, {"contents": 1}, "first page"),
)
#: Types in order of their first rule.
TYPES = tuple(dict.fromkeys(kind for kind, *_ in RULES))
SINGLE = {kind: (codes, ways, next(iter(patterns))) for kind, codes, ways, patterns, also in reversed(RULES) if len(patterns) == 1 and not also and codes and ways}


def classified(text: Column, page: Column, page_count: Column, boards: Column | None = None, core: bool = True) -> Column:
    """struct(kind, confidence): ``unknown`` at 0.3 if no rule holds. core: the rules by protection codes and by ``boards``,
    the number of boards a page names; else those by ways. A null text counts as ''."""
    body = F.coalesce(text, F.lit(""))
    table = [(n, kind, codes if core else ways, patterns, also) for n, (kind, codes, ways, patterns, also) in enumerate(RULES) if (codes if core else ways)]

    def holds(patterns: dict[str, int], also: str) -> Column:
        out = F.lit(True)
        for pattern, least in patterns.items():
            out = out & (~has(body, pattern) if least == 0 else has(body, pattern) if least == 1 else count(body, pattern) >= least)
        if also.startswith("first"):
            out = out & (page == 1) & (F.lit(True) if also == "first page" else page_count > 1)
        if also == "three boards":
            out = out & (F.lit(False) if boards is None else boards >= 3)
        return out

    fired = [F.struct(F.lit(n).alias("rule"), F.lit(kind).alias("kind"), F.when(holds(patterns, also), weight).otherwise(0).alias("weight"), F.lit(also.endswith("alone")).alias("alone")) for n, kind, weight, patterns, also in table]
    hits = F.filter(F.array(*fired), lambda x: x["weight"] > 0)
    others = F.filter(hits, lambda x: ~x["alone"])
    hits = F.when(F.size(others) > 0, others).otherwise(hits)

    def judged(found: Column) -> Column:
        total = lambda kind: F.aggregate(F.filter(found, lambda y: y["kind"] == kind), F.lit(0), lambda a, y: a + y["weight"])
        best = F.array_max(F.transform(found, lambda x: F.struct(total(x["kind"]).alias("score"), (-x["rule"]).alias("first"), x["kind"].alias("kind"))))
        step = 0.06 if core else 0.08
        sure = F.when(best.isNotNull(), F.round(F.least(F.lit(0.97), 0.5 + best["score"] * step), 6)).otherwise(0.3)
        return F.struct(F.coalesce(best["kind"], F.lit("unknown")).alias("kind"), sure.cast("double").alias("confidence"))

    return F.element_at(F.transform(F.array(hits), judged), 1)
