"""Normalisers of schedule fields. Each keeps its own set of separators and its own reading of absent values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.patterns import collapsed, first, first_rule, has, let, number, rx, text

NOT_SPECIFIED, UNCLEAR = "Not specified", "Unclear"

#: Device spellings and the family that each names.
DEVICE_FAMILIES = {
    "MCB": "MCB", "RCBO": "RCBO", "MCCB": "MCCB", "ACB": "ACB", "RCD": "RCD", "RCCB": "RCD", "SPD": "SPD", "FUSE": "Fuse",
    "ISOLATOR": "Isolator", "SWITCH": "Switch", "CONTACTOR": "Contactor", "TIMECLOCK": "Time clock", "TIME CLOCK": "Time clock",
    "PHOTOCELL": "Photocell", "RELAY": "Relay", "TIMER": "Timer", "STARTER": "Starter", "OVERLOAD": "Overload",
    "TRANSFORMER": "Transformer", "DALI CONTROLLER": "DALI controller", "AFDD+RCBO": "AFDD+RCBO", "RCBO+AFDD": "AFDD+RCBO", "METER": "Meter",
}
#: Report groups in report order, each with its families.
GROUPS = {
    "MCBs": ("MCB",), "RCBOs": ("RCBO",), "AFDD & Combined Protection": ("AFDD+RCBO",), "MCCBs": ("MCCB",), "ACBs": ("ACB",), "RCDs": ("RCD",),
    "Switches & Isolators": ("ISOLATOR", "SWITCH"), "Fuses": ("FUSE",), "Surge Protection": ("SPD",),
    "Contactors & Control": ("CONTACTOR", "TIME CLOCK", "PHOTOCELL", "RELAY", "TIMER", "STARTER", "OVERLOAD", "TRANSFORMER", "DALI CONTROLLER"),
    "Metering": ("METER",), "Other Devices": (),
}
#: Words that name pole arrangements, in order of precedence, and exact short forms.
POLE_WORDS = (
    ("SPN", r"\b(?:SINGLE\s+POLE\s+(?:AND|&)\s+NEUTRAL|1P\s*\+\s*N|SPN)\b"),
    ("DPN", r"\b(?:DOUBLE\s+POLE\s+(?:AND|&)\s+NEUTRAL|2P\s*\+\s*N|DPN)\b"),
    ("TPN", r"\b(?:(?:TRIPLE|THREE)\s+POLE\s+(?:AND|&)\s+NEUTRAL|3P\s*\+\s*N|TPN|TP&N)\b"),
    ("SP", r"^(?:SP|1P|SINGLE POLE)$"), ("DP", r"^(?:DP|2P|DOUBLE POLE)$"), ("TP", r"^(?:TP|3P|TRIPLE POLE|THREE POLE)$"), ("4P", r"^(?:4P|FOUR POLE)$"),
    (NOT_SPECIFIED, r"^NOT SPECIFIED$"), (UNCLEAR, r"^UNCLEAR$"), ("4P", r"^ *4(?:\.0*)? *$"), ("TPN", r"^ *3(?:\.0*)? *$"), ("DPN", r"^ *2(?:\.0*)? *$"), ("SPN", r"^ *1(?:\.0*)? *$"),
)
#: Words that tell the purpose of a circuit; explicit service first, then codes, then the description.
SERVICE_WORDS = (("Mechanical", r"\bmech(?:anical)?\b"), ("Small Power", r"\bsmall\s+power\b"), ("Power", r"\bpower\b"), ("Lighting", r"\blight(?:ing)?\b"))
PURPOSE_WORDS = (
    ("Lighting", r"\b(?:light|lighting|luminaires?|emergency lighting)\b"),
    ("Mechanical", r"\b(?:mechanical|ahu|fcu|mvhr|bms|boiler|chiller|ventilation|pump|heat pump|air conditioning|water heater|extract fan|condenser|condensor)\b"),
    ("Small Power", r"\bsmall\s+power\b|\bsocket(?:s| outlet)?\b"),
)
GENERAL = "General / unspecified"
#: Long names of protective devices.
LONG_NAMES = (
    (r"\bMINIATURE\s+CIRCUIT\s+BREAKER\b", "MCB"), (r"\bMOULDED\s+CASE\s+CIRCUIT\s+BREAKER\b", "MCCB"),
    (r"\bRESIDUAL\s+CURRENT\s+BREAKER\s+WITH\s+OVERCURRENT\b", "RCBO"), (r"\bRESIDUAL\s+CURRENT\s+DEVICE\b", "RCD"),
)


def norm_board(ref: Column) -> Column:
    """Upper case without blanks, dots, underscores, slashes and hyphens."""
    return F.regexp_replace(F.upper(text(ref)), r"[\s._/-]+", "")


def canonical_board(ref: Column) -> Column:
    """struct(display, norm, section): separators as single hyphens; a trailing LP, L or P behind a numbered DB ref is
    split off as the section."""

    def build(shown: Column) -> Column:
        stem = F.regexp_extract(shown, r"^(DB(?:-[A-Z0-9]+)+)-(LP|L|P)$", 1)
        split = stem.rlike(r"-\d{1,3}$")
        display = F.when(split, stem).otherwise(shown)
        return F.struct(
            display.alias("display"),
            F.regexp_replace(display, r"[\s._/\\-]+", "").alias("norm"),
            F.when(split, F.regexp_extract(shown, r"-(LP|L|P)$", 1)).alias("section"),
        )

    shown = F.regexp_replace(F.regexp_replace(F.upper(text(ref)), r"\s*[._/\\-]\s*", "-"), "-+", "-")
    return let(F.regexp_replace(shown, "^-|-$", ""), build)


def canonical_device(device: Column) -> Column:
    """The family of a device; texts of no known family stay as written, absent ones are ``Other device``."""
    raw = F.upper(text(device))
    for pattern, short in LONG_NAMES:
        raw = F.regexp_replace(raw, rx(pattern, False), short)
    raw = F.regexp_replace(F.trim(F.regexp_replace(raw, "[^A-Z0-9+]+", " ")), "S$", "")
    table = F.create_map(*[F.lit(x) for pair in DEVICE_FAMILIES.items() for x in pair])
    known = let(raw, lambda r: F.coalesce(F.try_element_at(table, r), F.try_element_at(table, F.replace(r, F.lit(" "), F.lit("")))))
    return F.coalesce(known, F.nullif(text(device), F.lit("")), F.lit("Other device"))


def group_of(device: Column) -> Column:
    key, out = F.upper(text(device)), None
    for name, members in GROUPS.items():
        if members:
            out = F.when(key.isin(*members), name) if out is None else out.when(key.isin(*members), name)
    return out.otherwise("Other Devices")


def group_rank(group: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(g) for g in GROUPS]), group), F.lit(0)), F.lit(len(GROUPS) + 1))


def pole(value: Column, phase: Column) -> Column:
    source = F.regexp_replace(F.replace(F.upper(text(value)), F.lit("."), F.lit("")), r"\s+", " ")
    three = F.when(F.upper(text(phase)).isin("3PH", "L1L2L3"), "TPN").otherwise(UNCLEAR)
    return first_rule(source, POLE_WORDS, three)


def curve(value: Column) -> Column:
    source = F.upper(text(value))
    compact = first(source, r"^([BCDKZ])\s*[- ]?\s*\d+(?:\.\d+)?\s*A?$", ignore_case=False)
    worded = first(source, r"\b(?:(?:TYPE|CURVE|CHARACTERISTIC)\s*[-:]?\s*)?([BCDKZ])(?:\s*[- ]?CURVE)?\b", ignore_case=False)
    return F.when(source.isin("", NOT_SPECIFIED.upper()), NOT_SPECIFIED).otherwise(F.coalesce(compact, worded, source))


def two_places(n: Column) -> Column:
    """A number without needless decimals, two at most."""
    return F.regexp_replace(F.regexp_replace(F.call_function("format_number", n, F.lit("0.00")), "0+$", ""), r"\.$", "")


def breaking_capacity(value: Column) -> Column:
    source = F.replace(text(value), F.lit(","), F.lit("."))
    amount = number(first(source, r"(\d+(?:\.\d+)?)"))
    absent = F.upper(source).isin("", NOT_SPECIFIED.upper())
    return F.when(absent, NOT_SPECIFIED).when(amount.isNull(), source).otherwise(F.concat(two_places(amount), F.lit("kA")))


def rating(value: Column) -> Column:
    """The first number above 0, else null."""
    n = number(first(F.replace(text(value), F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)"))
    return F.when(n > 0, n)


def format_rating(n: Column) -> Column:
    return F.when(n > 0, two_places(n)).otherwise("")


def device_label(device: Column, amps: Column, pole_name: Column) -> Column:
    shown = F.when(amps > 0, F.concat(format_rating(amps), F.lit("A"))).otherwise(NOT_SPECIFIED)
    poles = F.when(F.upper(device).isin("MCB", "RCBO", "AFDD+RCBO", "MCCB", "ACB", "RCD"), pole_name)
    return F.concat_ws(" ", shown, poles, device)


def purpose(service: Column, code: Column, description: Column) -> Column:
    c = F.upper(text(code))
    described = first_rule(F.lower(text(description)), PURPOSE_WORDS, F.lit(GENERAL))
    coded = F.when(c == "L", "Lighting").when(c == "P", "Power").otherwise(described)
    return first_rule(F.lower(text(service)), SERVICE_WORDS, coded)


def assisted_device(value: Column) -> Column:
    source = F.upper(F.coalesce(collapsed(value), F.lit("")))
    return (
        F.when(source == "", F.lit(None))
        .when(has(source, r"\bAFDD\b") & has(source, r"\bRCBO\b"), "AFDD+RCBO")
        .otherwise(
            first_rule(
                source,
                (("RCBO", r"\bRCBO\b"), ("MCCB", r"\bMCCB\b"), ("MCB", r"\bMCB\b"), ("RCD", r"\bRCD\b"), ("FUSE", r"\b(?:HRC\s+)?FUSE\b")),
                F.regexp_replace(source, r"\s*\+\s*", "+"),
            )
        )
    )


def safe_file_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(value), r'[<>:"/\\|?*\x00-\x1f]+', "-"), r"\s+", " ")


def three_type(page_type: Column) -> Column:
    """Page types collapsed to schematic, db_schedule, specification or other."""
    key = F.lower(text(page_type))
    return (
        F.when(key.isin("sld", "schematic"), "schematic")
        .when(key.isin("db-schedule", "main-schedule", "cable-schedule", "equipment-schedule", "cu", "switchboard", "mccb", "db_schedule"), "db_schedule")
        .when(key.isin("spec", "specification"), "specification")
        .otherwise("other")
    )

