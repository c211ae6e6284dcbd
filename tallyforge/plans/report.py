"""The take-off report: readings of devices to included rows, consolidated lines, sheets and the gate before any sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.functions.patterns import first, natural_key, number, text
from tallyforge.operators import consolidate as C
from tallyforge.operators.dedup import keep_best, with_retained

SPEC = ["device", "rating", "curve", "pole"]
#: Notes for buyers, by what is missing.
NOTES = {
    "curve": "Tripping curve not specified in the source document. No curve has been assumed.",
    "pole": "Pole configuration could not be confirmed from the source document.",
    "rating": "Current rating could not be confirmed from the source document.",
    "capacity": "Breaking capacity not specified in the source document.",
}
#: Notes on lines that differ from others in one attribute only.
CONFLICT_NOTES = {
    "curve": "Different tripping curves were read for otherwise equal devices; the lines stay apart.",
    "capacity": "Different breaking capacities were read for otherwise equal devices; the lines stay apart.",
    "pole": "Different pole configurations were read for otherwise equal devices; the lines stay apart.",
}
#: Purposes in report order; others follow by name.
PURPOSE_ORDER = (N.GENERAL, "Lighting", "Mechanical", "Power", "Small Power")
PURPOSES = ["Lighting", "Mechanical", "Power", "Small Power", N.GENERAL]


def way_number(way: Column) -> Column:
    return first(way, r"^\s*(?:way|w|cct|ckt|circuit)?[\s.:#]*0*([0-9]{1,9})(?:\.0+)?\s*$").try_cast("int")


def confidence(c: Column) -> Column:
    n = number(first(F.replace(text(c), F.lit(","), F.lit(".")), r"^([0-9]*\.?[0-9]+)\s*%?$"))
    return F.coalesce(F.when(c.contains("%"), n / 100).otherwise(n), F.lit(0.0))


def readings(devices: DataFrame) -> DataFrame:
    """Rows of the device table with normalised fields; quantity 0 for blank ways."""
    out = devices.select(
        "rec_id", "project_id", "file_id", "page", "received_at", N.norm_board(F.col("board_ref")).alias("board"), way_number(F.col("way")).alias("way"),
        F.upper(text(F.col("phase"))).alias("phase"), text(F.col("device_class")).alias("device_text"), N.canonical_device(F.col("device_class")).alias("device"),
        N.rating(F.col("rating_a")).alias("rating"), N.curve(F.col("trip_curve")).alias("curve"), N.pole(F.col("poles"), F.col("phase")).alias("pole"),
        text(F.col("description")).alias("description"), N.purpose(F.lit(None), F.lit(None), F.col("description")).alias("purpose"),
        confidence(F.col("confidence")).alias("conf"), F.coalesce("is_incomer", F.lit(False)).alias("incomer"),
    )
    space = F.upper(F.col("device_text")).isin("SPACE", "BLANK")
    return out.withColumns({"space": space, "qty": F.when(space, 0).otherwise(1).cast("bigint"), "grp": N.group_of(F.col("device"))})


def included(rows: DataFrame) -> DataFrame:
    """Rows that count: a device is named and the way is not blank."""
    return rows.where("device_text != '' AND NOT space")


def unique(rows: DataFrame) -> DataFrame:
    """One row for each circuit and specification, the surest reading."""
    return keep_best(rows, ["project_id", "board", "way", "phase", *SPEC], F.col("conf"), "rec_id")


def lines(rows: DataFrame) -> DataFrame:
    out = C.lines(rows, ["grp", *SPEC], "qty", "conf", lists={"purposes": "purpose"}, counts={"n_boards": "board_id"})
    return out.withColumns({"label": N.device_label(F.col("device"), F.col("rating"), F.col("pole")), "reasons": review(out), "notes": notes()})


def review(_: DataFrame) -> Column:
    return C.reasons(
        ("rating missing", F.col("rating").isNull()),
        ("curve not specified", F.col("curve") == N.NOT_SPECIFIED),
        ("pole configuration unclear", F.col("pole").isin(N.UNCLEAR, N.NOT_SPECIFIED)),
        ("low confidence", F.col("confidence") < 0.8),
    )


def notes() -> Column:
    return F.concat_ws(
        " ",
        F.when(F.col("rating").isNull(), NOTES["rating"]),
        F.when(F.col("curve") == N.NOT_SPECIFIED, NOTES["curve"]),
        F.when(F.col("pole").isin(N.UNCLEAR, N.NOT_SPECIFIED), NOTES["pole"]),
    )


def with_board(rows: DataFrame) -> DataFrame:
    """Adds ``board_id``: project and board in one text."""
    return rows.withColumn("board_id", F.concat_ws("|", "project_id", "board"))


def in_purpose_order(found: Column) -> Column:
    """An array of purposes as one text, in report order."""
    place = F.create_map(*[F.lit(x) for pair in zip(PURPOSE_ORDER, range(len(PURPOSE_ORDER))) for x in pair])
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(F.coalesce(F.try_element_at(place, x), F.lit(99)).alias("rank"), natural_key(x).alias("key"), x.alias("x"))))
    return F.array_join(F.transform(ranked, lambda y: y["x"]), ", ")


def model_lines(rows: DataFrame, spec: list[str], unknown: dict[str, list[str]]) -> DataFrame:
    """Consolidated lines under a specification: quantity, rows, boards, least confidence, applications, conflicts with lines
    that differ in one known attribute, reasons for review and status."""
    found = rows.groupBy("grp", *spec).agg(
        F.sum("qty").alias("quantity"), F.count("*").alias("n_rows"), F.count_distinct("board_id").alias("n_boards"), F.round(F.least(F.lit(1.0), F.min("conf")), 6).alias("confidence"),
        F.collect_set("purpose").alias("_purposes"),  # one of a handful of names
    )
    lined = C.conflicts(found.withColumn("applications", in_purpose_order(F.col("_purposes"))).drop("_purposes"), spec, unknown)
    reasons = C.reasons(
        ("rating missing", F.col("rating").isNull()),
        ("curve not specified", F.col("curve") == N.NOT_SPECIFIED),
        ("breaking capacity not specified", F.col("capacity") == N.NOT_SPECIFIED),
        ("pole configuration unclear", F.col("pole").isin(N.UNCLEAR, N.NOT_SPECIFIED)),
        ("low confidence", F.col("confidence") < 0.8),
    )
    clash = F.when(F.col("conflicts") != "", F.concat(F.lit("conflicting "), F.col("conflicts")))
    out = lined.withColumn("reasons", F.concat_ws("; ", F.nullif(reasons, F.lit("")), clash))
    return out.withColumn("status", F.when(F.col("reasons") == "", "Ready").otherwise("Review required"))


def line_sources(rows: DataFrame, spec: list[str]) -> DataFrame:
    """``spec, sources``: documents in order, each with its pages. Pages of a document are few; a line's text grows with its
    documents."""
    pages = source_pages(rows, spec)
    listed = F.array_sort(F.collect_list(F.struct("document", "pages")))
    return pages.groupBy(*spec).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["document"], x["pages"])), "; ").alias("sources"))


def takeoff_lines(model: DataFrame, sources: DataFrame, spec: list[str]) -> DataFrame:
    """Sheet lines in report order and the grand total last: ``category, label, rating, pole, curve, capacity, quantity,
    applications, sources, confidence, status, notes``."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in spec])
    joined = model.alias("l").join(sources.alias("o"), same, "left").select("l.*", "o.sources")
    clash = [F.when(F.array_contains(F.split("conflicts", ", "), a), F.lit(text_)) for a, text_ in CONFLICT_NOTES.items()]
    noted = joined.withColumn("notes", F.concat_ws(
        " ", F.when(F.col("rating").isNull(), NOTES["rating"]), F.when(F.col("curve") == N.NOT_SPECIFIED, NOTES["curve"]), F.when(F.col("capacity") == N.NOT_SPECIFIED, NOTES["capacity"]),
        F.when(F.col("pole").isin(N.UNCLEAR, N.NOT_SPECIFIED), NOTES["pole"]), *clash,
    )).withColumn("label", N.device_label(F.col("device"), F.col("rating"), F.col("pole")))
    none = F.lit(None).cast("string")
    columns = ["category", "label", "rating", "pole", "curve", "capacity", "quantity", "applications", "sources", "confidence", "status", "notes"]
    shown = F.when(F.col("rating").isNull(), N.NOT_SPECIFIED).otherwise(N.two_places(F.col("rating")))
    lines_ = noted.withColumns({"category": F.col("grp"), "_amps": F.col("rating"), "rating": shown})
    total = model.agg(F.sum("quantity").alias("quantity")).select(
        F.lit("Grand Total").alias("category"), "quantity", *[none.alias(c) for c in columns if c not in ("category", "quantity", "confidence")], F.lit(None).cast("double").alias("confidence")
    )
    poles = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in (("SPN", 1), ("DPN", 2), ("TPN", 3)) for x in p]), F.col("pole")), F.lit(9))
    whole = lines_.select(*columns, "_amps", F.lit(0).alias("_last")).unionByName(total.select(*columns, F.lit(None).cast("double").alias("_amps"), F.lit(1).alias("_last")))
    order = ["_last", N.group_rank(F.col("category")), F.col("_amps").asc_nulls_last(), poles, natural_key(F.col("curve")), natural_key(F.col("capacity")), natural_key(F.col("label"))]
    return whole.orderBy(*order).select(*columns)


def review_items(model: DataFrame, spec: list[str]) -> DataFrame:
    """``spec, quantity, reason, field``: one row for each reason of a line."""
    reason = F.col("reason")
    names = (("conflicting", "Conflict"), ("curve", "Tripping curve"), ("capacity", "Breaking capacity"), ("pole", "Pole configuration"), ("rating", "Current rating"))
    field = F.coalesce(*[F.when(reason.startswith(w) if w == "conflicting" else reason.contains(w), n) for w, n in names], F.lit("Source record"))
    return model.where("reasons != ''").select(*spec, "quantity", F.explode(F.split("reasons", "; ")).alias("reason")).withColumn("field", field)


def audit_evidence(rows: DataFrame, keys: list[str], spec: list[str]) -> DataFrame:
    """``rec_id, field, value, confidence, file_id, page, status, retained``: every field of every row; of repeated readings the
    surest counts and the others name it."""
    marked = with_retained(rows, keys, F.col("conf"), "rec_id")
    cells = C.contributors(marked, {c: c for c in spec})
    value = F.when(F.col("field") == "rating", N.two_places(F.col("rating"))).otherwise(F.col("value"))
    missing = F.col("value").isNull() | F.col("value").isin(N.NOT_SPECIFIED, N.UNCLEAR, "Other device")
    status = F.when(missing, "Review required").when(F.col("retained").isNotNull(), "Excluded duplicate").otherwise("Read from source")
    return cells.select("rec_id", "field", value.alias("value"), F.round("conf", 6).alias("confidence"), "file_id", "page", status.alias("status"), "retained")


def takeoff_sheet(rows: DataFrame, boards: list[str]) -> DataFrame:
    """Quantities of each line by board, with the grand total as a line of nulls; refuses rows that do not reconcile."""
    report = C.lines(rows, SPEC, "qty", "conf")
    C.assert_reconciled(C.gate(rows, report, rows.groupBy("board_id").agg(F.sum("qty").alias("quantity")), "qty", SPEC))
    return C.matrix(rows, SPEC, "board_id", boards, "qty")


def detail_sheet(rows: DataFrame) -> DataFrame:
    """Every row that counts, with its line's label."""
    return rows.select(
        "rec_id", "project_id", "board", "way", "phase", "grp", N.device_label(F.col("device"), F.col("rating"), F.col("pole")).alias("label"), "purpose", "qty", "file_id", "page"
    )


def audit_sheet(rows: DataFrame) -> DataFrame:
    """One line for each row and specification field, with its status."""
    cells = C.contributors(rows.select("rec_id", "conf", *SPEC), {"device": "device", "rating": "rating", "curve": "curve", "pole": "pole"})
    missing = F.col("value").isNull() | F.col("value").isin(N.NOT_SPECIFIED, N.UNCLEAR, "Other device")
    return cells.select(
        "rec_id", "field", F.when(F.col("field") == "rating", F.nullif(N.format_rating(F.col("rating")), F.lit(""))).otherwise(F.col("value")).alias("value"),
        F.when(missing, "Review required").otherwise("Read from source").alias("status"),
    )


def review_sheet(report: DataFrame) -> DataFrame:
    """One line for each review reason, with the field it is about and what to do."""
    reason = F.col("reason")
    field = (
        F.when(reason.contains("curve"), "Tripping curve").when(reason.contains("pole"), "Pole configuration").when(reason.contains("rating"), "Current rating").otherwise("Source record")
    )
    split = report.where("reasons != ''").select("label", "curve", "quantity", F.explode(F.split("reasons", "; ")).alias("reason"))
    return split.select("label", "curve", "quantity", "reason", field.alias("field"), F.concat(F.lit("Confirm "), F.lower(field)).alias("action"))


def qualification_sheet(report: DataFrame) -> DataFrame:
    """Each distinct note with the lines and devices it is about, and two standing statements."""
    spark = report.sparkSession
    noted = [report.where(rule).select(F.lit(text_).alias("note"), "quantity") for text_, rule in (
        (NOTES["rating"], F.col("rating").isNull()), (NOTES["curve"], F.col("curve") == N.NOT_SPECIFIED), (NOTES["pole"], F.col("pole").isin(N.UNCLEAR, N.NOT_SPECIFIED)),
    )]
    counted = noted[0].unionByName(noted[1]).unionByName(noted[2]).groupBy("note").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"))
    standing = [("Every total was reconciled before release.", 0, 0), ("No value has been assumed silently.", 0, 0)]
    return counted.unionByName(spark.createDataFrame(standing, "note string, n_lines bigint, quantity bigint"))


def source_pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, document, pages``: the pages of each document in order, as one text."""
    document = F.coalesce("file_id", F.lit("Not specified")).alias("document")
    pages = rows.where("page IS NOT NULL").groupBy(*keys, document).agg(F.array_sort(F.collect_set("page")).alias("p"))
    return pages.select(*keys, "document", F.concat(F.lit("p"), F.array_join(F.transform("p", lambda x: x.cast("string")), ", p")).alias("pages"))


def equipment(rows: DataFrame) -> DataFrame:
    """Rows of protective devices with ``device`` and ``qty`` of the control equipment that each description names."""
    from tallyforge.functions import detect

    protective = rows.where(F.upper("device").isin("MCB", "RCBO", "AFDD+RCBO", "MCCB", "ACB", "RCD", "FUSE"))
    named = protective.withColumn("e", F.explode(detect.equipment(F.col("description"))))
    return named.withColumns({"device": F.col("e.device"), "qty": F.col("e.qty"), "grp": F.lit("Control & associated equipment")}).drop("e")


def equipment_model(rows: DataFrame) -> DataFrame:
    """Control equipment that descriptions of protective devices name: ``device, quantity, n_rows, confidence``."""
    return equipment(rows).groupBy("device").agg(F.sum("qty").alias("quantity"), F.count("*").alias("n_rows"), F.round(F.least(F.lit(1.0), F.min("conf")), 6).alias("confidence"))


def full_detail(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that count and the equipment that they name, one each: ``rec_id, board_id, category, device, qty, associated,
    purpose, role, circuit, description, document, page``."""
    own = rows.withColumns({"associated": F.lit(False), "qty": F.col("qty").cast("double")})
    every = own.unionByName(equipment(rows).withColumn("associated", F.lit(True)))
    names = files.select("file_id", F.nullif(F.trim("file_name"), F.lit("")).alias("_name"))
    return every.join(names, "file_id", "left").select(
        "rec_id", "board_id", F.col("grp").alias("category"), "device", "qty", "associated", "purpose", F.when(F.col("incomer"), "Incomer").otherwise("Outgoing").alias("role"),
        F.coalesce(F.col("way").cast("string"), F.lit(N.NOT_SPECIFIED)).alias("circuit"), F.coalesce(F.nullif("description", F.lit("")), F.lit(N.NOT_SPECIFIED)).alias("description"),
        F.coalesce("_name", "file_id", F.lit(N.NOT_SPECIFIED)).alias("document"), "page",
    )


def review_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``record, retained, board_id, field, action``: unsure records, those without a rating, and repeated ones."""
    marked = with_retained(rows, keys, F.col("conf"), "rec_id")
    kept, none = F.col("retained").isNull(), F.lit(None).cast("bigint")
    item = lambda rule, field, action, retained=none: F.when(rule, F.struct(retained.alias("retained"), F.lit(field).alias("field"), F.lit(action).alias("action")))
    items = F.array_compact(F.array(
        item(~kept, "Duplicate record", "Excluded; the surest reading is kept", F.col("retained")), item(kept & (F.col("conf") < 0.8), "Confidence", "Confirm against the source"),
        item(kept & F.col("rating").isNull(), "Current rating", "Confirm against the source"),
    ))
    return marked.select(F.col("rec_id").alias("record"), "board_id", F.explode(items).alias("i")).select("record", "i.retained", "board_id", "i.field", "i.action")


def sheets(rows: DataFrame, files: DataFrame, spec: list[str], unknown: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The sheets of a workbook by name, in order: take-off, detail, review, qualifications, audit, control equipment."""
    model, keys = model_lines(rows, spec, unknown), ["project_id", "board", "way", "phase", *spec]
    noted = model.select("rating", "curve", "pole", "quantity")
    return {
        "Take-Off": takeoff_lines(model, line_sources(rows, spec), spec),
        "Detail": full_detail(rows, files).orderBy("document", "page", "rec_id", "associated"),
        "Review": review_items(model, spec),
        "Qualifications": qualification_sheet(noted),
        "Audit": audit_evidence(rows, keys, spec),
        "Control Equipment": equipment_model(rows),
    }
