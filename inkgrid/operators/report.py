"""Reports: counts of a page, candidates as JSON, and the nested document of a form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.operators import triage

SUMMARY = ("field_count", "passed_count", "failed_count", "review_count")


def _counts() -> list[Column]:
    return [
        F.count("*").alias("field_count"),
        F.count_if("passed").alias("passed_count"),
        F.count_if(~F.col("passed")).alias("failed_count"),
        F.count_if("needs_review").alias("review_count"),
        (F.count_if(~F.col("passed") & (F.col("message") != "")) == 0).alias("ok"),
    ]


def summary(checks: DataFrame) -> DataFrame:
    """A row for each page: how many fields, how many pass, fail and need review, and whether no failure has a message."""
    return checks.groupBy("page_id").agg(*_counts())


def source_label(provider: Column, reviewed: Column) -> Column:
    label = (
        F.when(provider == "vision-rule", "Checkbox")
        .when(provider.startswith("roi-vlm:"), "ROI-VLM")
        .when(provider.contains("fallback_cleaner"), "PP-OCR")
        .when(provider.isin("siliconflow", "aliyun"), "Cleaner")
        .when(provider.isin("mock", "unresolved"), "Unresolved")
        .otherwise("ROI-VLM")
    )
    return F.when(reviewed & ~provider.startswith("roi-vlm:"), "PP-OCR+ROI复核").otherwise(label)


def candidates_json(candidates: DataFrame) -> DataFrame:
    """page_id, candidates: a JSON map from field to its ranked candidates."""
    entry = F.struct(
        "rank", "block_id", "text", F.col("score").alias("block_score"), F.col("cand_score").alias("assignment_score"),
        F.array("x1", "y1", "x2", "y2").alias("box"), F.array("cx", "cy").alias("center"), "reason",
    )
    fields = candidates.groupBy("page_id", "field_id").agg(F.min("field_seq").alias("field_seq"), F.array_sort(F.collect_list(entry)).alias("list"))
    fields = fields.withColumn("list", F.transform("list", lambda e: e.dropFields("rank")))
    whole = F.array_sort(F.collect_list(F.struct("field_seq", "field_id", "list")))
    pairs = F.transform(whole, lambda f: F.struct(f["field_id"].alias("key"), f["list"].alias("value")))
    return fields.groupBy("page_id").agg(F.to_json(F.map_from_entries(pairs)).alias("candidates"))


def documents(checks: DataFrame, settings: Settings) -> DataFrame:
    """One nested row for each page, ready for df.write.json: summary, problems and fields, by one grouping of the checks."""
    field = F.struct(
        "field_seq", F.col("field_id").alias("id"), "label", "section", "bbox", "recognizer", "validator", "value", "normalized_value", "confidence", "provider", "model",
        source_label(F.col("provider"), F.col("reviewed")).alias("source_label"), "needs_review", "review_reason", "passed", F.when(F.col("passed"), "").otherwise(F.col("message")).alias("message"),
    )
    problem = F.when(F.col("slot") <= settings.issues, F.struct("slot", "text"))
    problems = F.transform(F.array_sort(F.collect_list(problem)), lambda p: p["text"]).alias("problems")
    rows = triage.with_slots(checks).groupBy("page_id").agg(*_counts(), F.array_sort(F.collect_list(field)).alias("fields"), problems)
    none = F.when(F.size("problems") > 0, F.col("problems")).otherwise(F.array(F.lit("通过")))
    return rows.select("page_id", "ok", F.struct(*SUMMARY).alias("summary"), none.alias("problems"), "fields")


def write(reports: DataFrame, path: str) -> None:
    """The documents as JSON lines."""
    reports.write.mode("overwrite").json(path)
