"""Folders of finished results: files that may be missing, and bundles of a report with defaults for what it lacks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import text as t

FIELD = "struct<id:string,label:string,value:string,normalized_value:string,provider:string,passed:boolean,message:string,source_label:string,needs_review:boolean,review_reason:string>"
REPORT = f"ok boolean, fields array<{FIELD}>, problems array<string>"
REVIEW_REASON = "需人工复核"


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON documents at a path; none where it does not exist."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def optional_text(spark: SparkSession, path: str) -> str:
    """A small file's text; empty where it does not exist."""
    try:
        found = spark.read.option("wholetext", True).text(path).limit(1).collect()
    except AnalysisException as error:
        if not _missing(error):
            raise
        return ""
    return found[0][0] if found else ""


def run_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether a run has a summary, its model, job and counts; a run without one has its path only."""
    schema = "model string, job_id string, records bigint, markdown_files array<string>, downloaded_images array<string>"
    found = optional_json(spark, f"{path}/summary.json", schema).withColumn("exists", F.lit(True))
    one = spark.createDataFrame([(path,)], "path string")
    rows = one.join(found, F.lit(True), "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.when(F.col("exists"), F.coalesce(c, none)) for c in ("markdown_files", "downloaded_images")})


def with_defaults(reports: DataFrame, source_label: Column, risky: tuple[str, ...] = ()) -> DataFrame:
    """Reports whose fields get the keys they lack; what is there stays.

    source_label is made of the column `provider`. Fields named in `risky`, and those without a value, need review.
    """
    field = F.col("f")
    unread = t.first_filled(field["value"], field["normalized_value"]) == ""
    needs = F.coalesce(field["needs_review"], unread | field["id"].isin(*risky) if risky else unread)
    rows = reports.withColumn("__row", F.monotonically_increasing_id()).select("*", F.posexplode_outer("fields").alias("__n", "f"))
    rows = rows.withColumn("provider", F.coalesce(field["provider"], F.lit("")))
    made = {
        "source_label": F.coalesce(field["source_label"], source_label),
        "needs_review": needs,
        "review_reason": F.coalesce(field["review_reason"], F.when(needs, REVIEW_REASON).otherwise("")),
    }
    for name, value in made.items():
        rows = rows.withColumn(f"__{name}", value)
    filled = F.when(field.isNotNull(), field.withField("source_label", F.col("__source_label")).withField("needs_review", F.col("__needs_review")).withField("review_reason", F.col("__review_reason")))
    whole = F.transform(F.array_sort(F.collect_list(F.when(field.isNotNull(), F.struct("__n", filled.alias("f"))))), lambda x: x["f"]).alias("fields")
    kept = [c for c in reports.columns if c != "fields"]
    return rows.groupBy("__row").agg(*[F.first(c).alias(c) for c in kept], whole).select(*reports.columns)
