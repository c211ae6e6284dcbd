"""Reading pages: text files, delimited rows, the JSON cache of a reading run, and page files as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "struct<text:string,bbox:array<double>,confidence:double>"
#: One file a document: pages with their own lines, and lines read from images where a page has no text layer.
META = f"file string, pages array<struct<page:int,width:double,height:double,native:boolean,lines:array<{LINE}>>>, _corrupt string"
READ = f"file string, page int, lines array<{LINE}>, error string, _corrupt string"
#: Results of a model for a page, all leaves strings; '' stands for absent.
RESULT = (
    "boards array<struct<ref:string,description:string,fed_from_ref:string,ways_total:string,phase_config:string>>,"
    "devices array<struct<board_ref:string,way:string,phase:string,device_class:string,rating_a:string,poles:string,rcd_ma:string,cpc_csa_mm2:string,description:string,"
    "is_spare:boolean,is_spd:boolean,is_incomer:boolean,confidence:string>>,"
    "feeds array<struct<from_ref:string,to_ref:string,device_class:string,rating_a:string,cable_ref:string,confidence:string>>"
)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, page, text`` of text files, pages parted by form feeds. An empty file has no page."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.posexplode(F.split("value", "\f")).alias("_n", "text"))
    return files.select("file_id", (F.col("_n") + 1).alias("page"), "text")


def cached_pages(spark: SparkSession, meta: str, read: str) -> DataFrame:
    """``file_id, page, native, lines, error`` from the cache of a run: own lines of native pages, else those read from the
    image. Unreadable files become rows with an error; the run goes on."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true"}
    pages = spark.read.schema(META).options(**options).json(meta).select("file", "_corrupt", F.explode_outer("pages").alias("p"))
    images = spark.read.schema(READ).options(**options).json(read).select("file", "page", F.col("lines").alias("image_lines"), F.col("error"))
    joined = pages.select("file", F.col("p.page").alias("page"), F.col("p.native").alias("native"), F.col("p.lines").alias("lines"), "_corrupt").join(images, ["file", "page"], "left")
    chosen = F.when(F.col("native"), F.col("lines")).otherwise(F.col("image_lines"))
    bad = F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable cache file")).otherwise(F.col("error"))
    return joined.select(F.col("file").alias("file_id"), "page", F.coalesce("native", F.lit(False)).alias("native"), chosen.alias("lines"), bad.alias("error"))


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, all columns of ``schema`` (texts by contract) and ``_corrupt``: lines that do not fit
    stay, with what they hold, instead of ending the run. A byte order mark and quoted line ends are read over."""
    options = {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true", "escape": '"', "enforceSchema": "true"}
    return spark.read.options(**options).schema(f"{schema}, _corrupt string").csv(path)


def model_results(df: DataFrame, json: str) -> DataFrame:
    """Adds ``result`` from JSON texts; unreadable ones are null."""
    return df.withColumn("result", F.from_json(json, RESULT, {"mode": "PERMISSIVE"}))


def result_devices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Devices of results with numbers as numbers: '' and unreadable ones are null."""
    d = df.select(*keys, F.explode("result.devices").alias("d")).select(*keys, "d.*")
    numbers = {c: F.nullif(F.trim(c), F.lit("")).try_cast("double") for c in ("rating_a", "rcd_ma", "confidence")}
    counts = {c: F.nullif(F.trim(c), F.lit("")).try_cast("double").cast("int") for c in ("way", "poles")}
    mixed = F.nullif(F.trim("cpc_csa_mm2"), F.lit(""))
    return d.withColumns(numbers | counts | {"cpc_raw": mixed, "cpc_mm2": mixed.try_cast("double")}).drop("cpc_csa_mm2")


def binary_pages(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, length, content`` of page files; decoding is a plug-in's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
