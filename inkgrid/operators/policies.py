"""Small decisions around models, as Column expressions: what an answer says, how sure it is, whom to ask next, what to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import text as t

# The confidence of a recogniser's reading that came without one, and of an answer that is no JSON.
UNSTATED, UNPARSED = 0.72, 0.5
#: The provider whose failed readings are asked for again, of another model.
RETRIED_PROVIDER = "aliyun"
ANSWER = "struct<value:string,normalized_value:string,confidence:string>"


def confidence(stated: Column, model: Column, value: Column, normalized: Column) -> Column:
    """An answer's confidence; UNSTATED where a recogniser (by its model's name) gives a value but none above 0; what is no number is 0."""
    number = F.coalesce(stated.try_cast("double"), F.lit(0.0))
    read = (t.first_filled(value, normalized) != "") & F.lower(F.coalesce(model, F.lit(""))).contains("ocr")
    return F.when((number <= 0) & read, UNSTATED).otherwise(number)


def reading(answer: Column) -> Column:
    """A model's answer as ANSWER: the JSON between its braces; without braces the bare text, with confidence UNPARSED; all null for broken JSON."""
    inside, text = t.json_inside(answer), t.unfenced(answer)
    bare = F.struct(text.alias("value"), text.alias("normalized_value"), F.lit(str(UNPARSED)).alias("confidence"))
    return F.when(inside.isNull(), bare).otherwise(F.from_json(inside, ANSWER))


def readings(answers: DataFrame) -> DataFrame:
    """Rows with a model's `answer` and its `model` as value, normalized_value, confidence and error, as review.merge takes them."""
    rows = answers.withColumn("__a", reading(F.col("answer")))
    value, normal = t.strip(F.col("__a.value")), t.strip(F.col("__a.normalized_value"))
    broken = F.col("__a").isNull() | (F.col("__a.value").isNull() & F.col("__a.normalized_value").isNull() & F.col("__a.confidence").isNull())
    made = {
        "value": value,
        "normalized_value": t.first_filled(normal, value),
        "confidence": confidence(F.col("__a.confidence"), F.col("model"), value, normal),
        "error": F.when(broken, "unreadable answer"),
    }
    return rows.withColumns(made).drop("__a")


def fallback_model(provider: Column, model: Column, settings: Settings) -> Column:
    """The model to ask when one fails; empty if there is no other."""
    other = F.lit(settings.fallback_model)
    return F.when((provider == RETRIED_PROVIDER) & ~model.eqNullSafe(other), other).otherwise("")


def asks_again(provider: Column, model: Column, value: Column, normalized: Column, error: Column, settings: Settings) -> Column:
    """Whether a reading is asked for again: of that provider, empty, with an error, and with another model to ask."""
    empty = t.first_filled(value, normalized) == ""
    return F.coalesce((provider == RETRIED_PROVIDER) & empty & error.isNotNull() & (fallback_model(provider, model, settings) != ""), F.lit(False))


def skips_triage(error: Column, fallback_sections: Column, settings: Settings) -> Column:
    """Whether a page's issues are ranked by rule alone since its cleaning failed: with an error, or for some section."""
    failed = (F.coalesce(error, F.lit("")) != "") | (F.coalesce(F.size(fallback_sections), F.lit(0)) > 0)
    return F.lit(settings.skip_triage_on_error) & failed


def evidence_url(run_id: Column, path: Column) -> Column:
    """The address of an evidence image, by the folder it is in."""
    parts = F.split(path, "/")
    name, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    inside = F.when(folder.isin("ppocr_rois", "rois"), F.concat(folder, F.lit("/"))).otherwise("")
    return F.concat(F.lit("/runs/"), run_id, F.lit("/"), inside, name)


def evidence_of(rows: DataFrame, *sources: DataFrame) -> DataFrame:
    """Adds evidence_path of (page_id, field_id): of the first source that has one (each with page_id, field_id, path)."""
    for k, source in enumerate(sources):
        rows = rows.join(source.groupBy("page_id", "field_id").agg(F.min("path").alias(f"__path{k}")), ["page_id", "field_id"], "left")
    held = [F.col(f"__path{k}") for k in range(len(sources))]
    return rows.withColumn("evidence_path", F.coalesce(*held) if held else F.lit(None).cast("string")).drop(*[f"__path{k}" for k in range(len(sources))])


def section_times(sections: DataFrame) -> DataFrame:
    """A row for each page from sections (page_id, section, first_seq, duration_ms, cache_hit, fallback, fallback_cached, error).

    The longest and all times, how many fell back, whether all came from the cache and any fallback did, and the errors of
    those that fell back (their names where they have none), in the order of the form.
    """
    fell = F.coalesce("fallback", F.lit(False))
    message = F.struct("first_seq", "section", t.first_filled(F.col("error"), F.col("section")).alias("e"))
    return sections.groupBy("page_id").agg(
        F.max(F.coalesce("duration_ms", F.lit(0))).alias("section_max_ms"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("section_sum_ms"),
        F.count_if(fell).alias("fallback_count"),
        F.bool_and(F.coalesce("cache_hit", F.lit(False))).alias("cache_hit"),
        F.bool_or(F.coalesce("fallback_cached", F.lit(False))).alias("fallback_cached"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fell, message))), lambda m: m["e"]), "; ").alias("error"),
    )
