"""Quality of page texts, plans for reading them again, and the choice of the best reading."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import detect
from tallyforge.functions.patterns import count, has, let

#: The score from which a text layer is used as it is.
RELIABLE = 0.62
#: Characters that are not printable: controls but tab and line feed, and the replacement character.
_HIDDEN = "".join(chr(c) for c in range(32) if c not in (9, 10)) + "\ufffd"


def page_quality(text: Column, expected_type: Column, order_errors: Column | None = None, boxes: Column | None = None) -> Column:
    """struct(score, reliable, route, characters, lines, printable, alphanumeric, signals). An absent text scores 0."""
    errors = F.lit(0) if order_errors is None else order_errors
    pairs = F.lit(1) if boxes is None else F.greatest(F.lit(1), boxes - 1)

    def measured(t: Column) -> Column:
        n = F.greatest(F.lit(1), F.length(t))
        of = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))  # noqa: E731  no array of matches is built
        tokens = F.regexp_count(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9+&./-]*"))
        longer = F.regexp_count(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9+&./-]+"))
        return F.struct(
            F.length(t).alias("characters"),
            (of("\n") + 1).alias("lines"),
            ((F.length(t) - of(_HIDDEN)) / n).alias("printable"),
            (of(string.ascii_letters + string.digits) / n).alias("alphanumeric"),
            of("\ufffd").alias("corrupt"),
            tokens.alias("tokens"),
            (tokens - longer).alias("single"),
            detect.signals(t).alias("signals"),
            (errors / pairs).alias("disorder"),
        )

    def rated(m: Column) -> Column:
        dense = F.coalesce(has(expected_type, "schedule|table"), F.lit(False))
        thin = dense & ((m["characters"] < 80) | (m["lines"] < 3))
        cap = lambda most, value: F.least(F.lit(most), value)
        score = (
            0.15 + cap(0.25, m["characters"] / 1200) + cap(0.12, m["lines"] / 30) + m["printable"] * 0.18 + cap(0.10, m["tokens"] / 120) + cap(0.12, m["signals"] / 30)
            + F.when((m["printable"] > 0.96) & (m["alphanumeric"] > 0.45), 0.18).otherwise(0.0)
            - cap(0.45, m["corrupt"] / F.greatest(F.lit(1), m["characters"]) * 8) - cap(0.35, m["disorder"] * 1.5)
            - F.when(thin, 0.35).otherwise(0.0) - F.when((m["tokens"] > 0) & (m["single"] / F.greatest(F.lit(1), m["tokens"]) > 0.55), 0.2).otherwise(0.0)
        )
        clean = F.when(m["characters"] == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
        return let(F.struct(clean.alias("score"), m.alias("m")), finished)

    def finished(s: Column) -> Column:
        m = s["m"]
        good = (s["score"] >= RELIABLE) & (m["printable"] >= 0.9) & (m["corrupt"] == 0) & ~(m["disorder"] > 0.12)
        return F.struct(
            s["score"].alias("score"), good.alias("reliable"), F.when(good, "embedded_text").otherwise("ocr").alias("route"), m["characters"].alias("characters"),
            m["lines"].alias("lines"), m["printable"].alias("printable"), m["alphanumeric"].alias("alphanumeric"), m["signals"].alias("signals"),
        )

    return let(let(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c")), measured), rated)


def reading_plan(width: Column, height: Column, text_height: Column, orientation: Column, skew: Column, contrast: Column, noise: Column, uneven: Column) -> Column:
    """array of struct(id, rotation, deskew, scale, contrast, threshold, denoise): the ways to render a page again."""
    turn = F.when(orientation.isin(90, 180, 270), orientation).otherwise(0).cast("int")
    smaller = F.least(F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(2000.0)), F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(2000.0)))
    low = (F.coalesce(F.nullif(text_height, F.lit(0.0)), F.lit(12.0)) < 9) | (smaller < 800)
    scale = F.when(low, 3.0).otherwise(2.25)

    def entry(name: Column, rotation: Column, boost: float, deskew: Column = F.lit(0.0), size: Column = scale, threshold: str | None = None, denoise: Column = F.lit(False)) -> Column:
        return F.struct(
            name.alias("id"), rotation.cast("int").alias("rotation"), deskew.cast("double").alias("deskew"), size.cast("double").alias("scale"), F.lit(boost).alias("contrast"),
            F.lit(threshold).cast("string").alias("threshold"), F.coalesce(denoise, F.lit(False)).alias("denoise"),
        )

    poor = F.coalesce(contrast < 0.2, F.lit(False)) | F.coalesce(uneven, F.lit(False)) | F.coalesce(noise > 0.2, F.lit(False))
    return F.array_compact(
        F.array(
            entry(F.lit("base"), F.lit(0), 1.08),
            entry(F.lit("enhanced"), turn, 1.35),
            F.when(turn != 0, entry(F.concat(F.lit("rotate-"), turn), turn, 1.2)),
            F.when(F.abs(F.coalesce(skew, F.lit(0.0))) >= 0.35, entry(F.lit("deskew"), turn, 1.25, -skew)),
            F.when(poor, entry(F.lit("adaptive-threshold"), turn, 1.45, threshold="adaptive", denoise=noise > 0.15)),
            F.when(low, entry(F.lit("upscaled"), turn, 1.3, size=F.lit(3.0))),
        )
    )


def candidate_score(text: Column, confidence: Column, expected_type: Column) -> Column:
    """The score of one reading: its own confidence, the quality of its text, domain words and table rows."""
    sure = F.coalesce(F.when(confidence > 1, confidence / 100).otherwise(confidence), F.lit(0.0))
    whole = F.coalesce(text, F.lit(""))
    words = count(whole, r"\b(?:MCB|MCCB|RCBO|RCD|AFDD|SPD|SPN|DPN|TPN|L[123]|\d+(?:\.\d+)?\s*(?:A|MA|KA))\b")
    rows = F.size(F.filter(F.split(whole, r"\r?\n"), lambda x: has(x, r"(?:^|\s)(?:\d{1,3}\s*(?:/\s*)?L[123]|L[123]\s+\d+(?:\.\d+)?)")))
    total = sure * 0.45 + page_quality(text, expected_type)["score"] * 0.42 + F.least(F.lit(0.08), words * 0.008) + F.least(F.lit(0.05), rows * 0.01)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)
