"""From ranked candidates to one value for each field: best text, normalisation, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import text as t
from inkgrid.functions.once import computed_once, dealt
from inkgrid.operators.rules import repaired_range

REVIEW_REASON = "需人工复核"
SLOW_REASON = "Cleaner超时，使用本地候选兜底"


def _entry() -> Column:
    return F.struct("rank", "block_id", "text", F.col("score").alias("block_score"), "cand_score", "x1", "y1", "x2", "y2", "cx", "cy", "reason")


def gathered(candidates: DataFrame) -> DataFrame:
    """One row for each field of a page with its candidates in order of rank (at most the few that matching keeps)."""
    return candidates.groupBy("page_id", "field_id").agg(F.array_sort(F.collect_list(_entry())).alias("cands"))


def merged_digits(cands: Column) -> Column:
    """The first candidate's digits, lengthened by digits to its right until the field has enough; empty if it has none.

    A fragment must stand right of the first box and level with it, have a quarter of its score, and follow the digits so far
    within 2.2 heights (55 at least).
    """
    first = cands[0]
    start = t.digits_or_empty(first["text"])
    height = F.greatest(first["y2"] - first["y1"], F.lit(1.0)).cast("double")

    def extends(c: Column) -> Column:
        level = F.abs(c["cy"] - first["cy"]) <= F.greatest(height, c["y2"] - c["y1"], F.lit(1.0)) * 0.75
        return (t.digits_or_empty(c["text"]) != "") & (c["x1"] >= first["x2"] - height * 0.2) & level & (c["cand_score"] >= first["cand_score"] * 0.25)

    fragments = F.array_sort(F.transform(F.filter(F.slice(cands, 2, 7), extends), lambda c: F.struct(c["x1"].cast("double").alias("x1"), c["rank"].alias("rank"), c["x2"].cast("double").alias("x2"), t.digits_or_empty(c["text"]).alias("d"))))
    so_far = F.struct(start.alias("d"), first["x2"].cast("double").alias("edge"))

    def joined(s: Column, c: Column) -> Column:
        fits = (F.length(s["d"]) + F.length(c["d"]) <= F.col("max_digits")) & (c["x1"] - s["edge"] <= F.greatest(height * 2.2, F.lit(55.0)))
        return F.struct(F.when(fits, F.concat(s["d"], c["d"])).otherwise(s["d"]).alias("d"), F.when(fits, F.greatest(s["edge"], c["x2"])).otherwise(s["edge"]).alias("edge"))

    lengthened = F.aggregate(fragments, so_far, joined)["d"]
    return F.when((start == "") | (F.length(start) >= F.least("max_digits", "enough_digits")), start).otherwise(lengthened)


def best_text(cands: Column) -> Column:
    """What a field's candidates say, by its rule."""
    rule, first = F.col("validator"), F.get(cands, F.lit(0))["text"]
    english = F.filter(F.transform(F.slice(cands, 1, 6), lambda c: t.english_only(c["text"])), lambda x: x != "")
    body = F.transform(F.filter(F.slice(cands, 1, 8), lambda c: t.is_body(c["text"])), lambda c: t.strip(c["text"]))
    free = (rule == "bilingual_text") | ((rule == "present") & (F.col("assignment.value_type") == "free_text"))
    return (
        F.when(F.size(cands) == 0, "")
        .when(rule.isin("digit_length", "number_less_than"), t.first_filled(merged_digits(cands), first))
        .when(rule.isin("english_text", "contains_english"), F.array_join(english, " "))
        .when(F.coalesce(free, F.lit(False)), F.array_join(body, " "))
        .otherwise(first)
    )


def normal_value(value: Column) -> Column:
    """A value in the form its rule compares. White space at its ends never counts; each form sees to that itself."""
    rule, text = F.col("validator"), F.coalesce(value, F.lit(""))
    return (
        F.when(rule.isin("english_text", "contains_english"), t.english_only(text))
        .when(rule == "exact_text", t.exact_value(text))
        .when(rule == "prefix_or_exact", F.when(t.with_na(text) == "N/A", "N/A").otherwise(F.upper(t.compact(text))))
        .when(rule == "int_range", repaired_range(text))
        .when(rule == "regex", t.for_pattern(text, F.coalesce("params.pattern", F.lit(""))))
        .when(rule == "same_day", t.date_text(text))
        .when(rule.isin("digit_length", "number_less_than"), F.regexp_replace(text, "[^0-9]", ""))
        .otherwise(t.strip(text))
    )


def local_clean(pages: DataFrame, fields: DataFrame, candidates: DataFrame, provider: str = "local", model: str = "rules") -> DataFrame:
    """A recognition for every field of every page (repeated or not), with the catalogue's columns; fields without candidates need review.

    Repeated pages are made one where they lie. Candidates are grouped by field, then fields by page, in a map where each field finds
    its own; what follows is local to a page.
    """
    own = gathered(dealt(candidates, "page_id")).select("page_id", F.struct("field_id", "cands").alias("own"))
    kind, cands = own.schema["own"].dataType.simpleString(), own.schema["own"].dataType["cands"].dataType.simpleString()
    every = own.unionByName(dealt(pages.select("page_id").distinct().select("page_id", F.lit(None).cast(kind).alias("own")), "page_id"))
    found = every.groupBy("page_id").agg(F.map_from_entries(F.collect_list("own")).alias("found"))
    rows = found.crossJoin(F.broadcast(fields)).withColumn("cands", F.coalesce(F.try_element_at("found", F.col("field_id")), F.array().cast(cands))).drop("found")
    rows = computed_once(rows, "cands")
    some = F.size("cands") > 0
    rows = rows.withColumns(
        {
            "value": F.coalesce(best_text(F.col("cands")), F.lit("")),
            "confidence": F.when(some, F.least(F.get("cands", F.lit(0))["cand_score"] / 3.0, F.lit(0.95))).otherwise(0.0),
            "provider": F.lit(f"{provider}:fallback_cleaner"),
            "model": F.lit(model),
        }
    )
    rows = computed_once(rows, "value", "confidence")
    review = F.coalesce("assignment.needs_review", F.lit(False)) | ~some | (F.col("confidence") < 0.45)
    rows = rows.withColumns({"normalized_value": normal_value(F.col("value")), "needs_review": review})
    return computed_once(rows.withColumn("review_reason", F.when(F.col("needs_review"), REVIEW_REASON).otherwise("")), "normalized_value", "needs_review", "review_reason")


def sections(rows: DataFrame) -> DataFrame:
    """page_id, section, first_seq, field_ids: what a cleaning model would be asked, section by section."""
    asked = rows.filter((F.col("recognizer") != "checkbox") & (F.size("cands") > 0))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("field_seq", "field_id"))), lambda x: x["field_id"])
    return asked.groupBy("page_id", "section").agg(F.min("field_seq").alias("first_seq"), ids.alias("field_ids"))


def asked_candidates(cands: Column) -> Column:
    """The candidates that a cleaning model is shown: six, for free text those that read like a body, if any do."""
    free = F.col("validator").isin("bilingual_text", "contains_english") | F.coalesce(F.col("assignment.value_type") == "free_text", F.lit(False))
    bodies = F.filter(F.slice(cands, 1, 10), lambda c: t.is_body(c["text"]))
    return F.slice(F.when(free & (F.size(bodies) > 0), bodies).otherwise(cands), 1, 6)


def requests(rows: DataFrame) -> DataFrame:
    """page_id, section, payload: what a model is sent for each section, as JSON."""
    shown = F.transform(asked_candidates(F.col("cands")), lambda c: F.struct(c["text"].alias("text"), F.round(c["cand_score"], 4).alias("score")))
    asked = rows.filter((F.col("recognizer") != "checkbox") & (F.size("cands") > 0)).withColumn("__shown", shown)
    entry = F.struct("field_seq", F.col("field_id").alias("id"), "label", "validator", F.col("__shown").alias("candidates"))
    return asked.groupBy("page_id", "section").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))


#: What a model's value or a second reading says.
READING = ("value", "normalized_value", "confidence", "error")


def one_of_each(readings: DataFrame, columns: tuple[str, ...] = READING) -> DataFrame:
    """One reading for each (page_id, field_id), its columns as __<name>: the last by the column `seq` where there is one.

    Of several with one seq, or without that column, one without an error comes first, then the surest, then the greater text.
    """
    seq = [F.col("seq")] if "seq" in readings.columns else []
    order = F.struct(*seq, F.col("error").isNull(), F.coalesce("confidence", F.lit(0.0)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = readings.groupBy("page_id", "field_id").agg(F.max_by(F.struct(*columns), order).alias("__r"))
    return rows.select("page_id", "field_id", *[F.col(f"__r.{c}").alias(f"__{c}") for c in columns])


def overlay(local: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Puts a model's values (page_id, field_id, value, normalized_value, confidence, error) over the local ones.

    A row with an error keeps the local value, which needs review below 0.8. Where they have needs_review and reason too, these
    say whether the model's value needs review, besides the catalogue. Of several values of a field one counts, as
    one_of_each has it.
    """
    own = tuple(c for c in ("needs_review", "reason") if c in cleaned.columns)
    rows = local.join(one_of_each(cleaned, READING + own), ["page_id", "field_id"], "left")
    failed, done = F.col("__error").isNotNull(), F.col("__value").isNotNull() & F.col("__error").isNull()
    rows = rows.withColumns({c: F.when(done, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in ("value", "normalized_value", "confidence")})
    rows = rows.withColumn("needs_review", F.when(failed, F.col("needs_review") | (F.col("confidence") < 0.8)).otherwise(F.col("needs_review")))
    rows = rows.withColumn("review_reason", F.when(failed & (F.col("review_reason") == ""), SLOW_REASON).otherwise(F.col("review_reason")))
    if own == ("needs_review", "reason"):
        asked = F.coalesce("__needs_review", F.lit(False)) | F.coalesce("assignment.needs_review", F.lit(False))
        rows = rows.withColumns({"needs_review": F.when(done, asked).otherwise(F.col("needs_review")), "review_reason": F.when(done, F.coalesce("__reason", F.lit(""))).otherwise(F.col("review_reason"))})
    return rows.drop(*[f"__{c}" for c in READING + own])
