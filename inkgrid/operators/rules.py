"""The rule registry: each rule is a Column over a value, the field's catalogue columns and the expected date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import text as t
from inkgrid.functions.once import computed_once
from inkgrid.sources.catalog import OIL_QUANTITIES

Rule = Callable[[Column, Settings], Column]
REGISTRY: dict[str, Rule] = {}
SIGNED_NUMBER = r"(-?[0-9]+(?:[.][0-9]+)?)"


def rule(*names: str) -> Callable[[Rule], Rule]:
    """Registers a rule; a user's own rules are added the same way."""

    def add(f: Rule) -> Rule:
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return add


def first_number(value: Column) -> Column:
    # An empty text is not cast: a failed cast is an exception, which takes long.
    return F.nullif(F.regexp_extract(value, SIGNED_NUMBER, 1), F.lit("")).try_cast("double")


def repaired_range(value: Column) -> Column:
    """An oil quantity that was read 7x for 2x, where 2x is in range; else the value."""
    bare = t.compact(value)
    fixed = F.concat(F.lit("2"), F.substring(bare, 2, 100))
    fits = F.col("field_id").isin(*OIL_QUANTITIES) & t.whole(bare, "7[0-9](?:[.][0-9]+)?") & fixed.try_cast("double").between(F.col("params.min"), F.col("params.max"))
    return F.when(fits, fixed).otherwise(t.normalized(value))


@rule("int_range")
def int_range(value: Column, settings: Settings) -> Column:
    return first_number(repaired_range(value)).between(F.col("params.min"), F.col("params.max"))


@rule("exact_text")
def exact_text(value: Column, settings: Settings) -> Column:
    return F.array_contains("allowed", t.comparable(value))


@rule("checked")
def checked(value: Column, settings: Settings) -> Column:
    return F.lower(value).isin(*t.CHECKED_WORDS)


@rule("english_text")
def english_text(value: Column, settings: Settings) -> Column:
    return value.rlike("[A-Za-z]") & ~value.rlike(t.CJK)


@rule("contains_english")
def contains_english(value: Column, settings: Settings) -> Column:
    return value.rlike("[A-Za-z]")


@rule("bilingual_text")
def bilingual_text(value: Column, settings: Settings) -> Column:
    letters, cjk = F.regexp_count(value, F.lit("[A-Za-z]")), F.regexp_count(value, F.lit(t.CJK))
    least = lambda name: F.greatest(F.coalesce(F.col(f"params.{name}"), F.lit(1)), F.lit(1))
    return (letters >= least("min_letters")) & (cjk >= least("min_cjk"))


@rule("name_not_place")
def name_not_place(value: Column, settings: Settings) -> Column:
    key, bare = t.comparable(value), t.compact(value)
    noise = F.array(*[F.lit(w) for w in t.NAME_NOISE])
    noisy = F.array_contains(F.transform(noise, F.lower), key) | F.array_contains(noise, F.upper(bare))
    noisy = noisy | F.upper(t.normalized(value)).rlike("|".join(t.NAME_NOISE_PARTS))
    empty = (key == "") | F.array_contains("forbidden", key) | (t.with_na(value) == "N/A") | t.is_date(value) | t.whole(bare, t.NUMBER)
    return ~empty & ~noisy & value.rlike(rf"{t.CJK}|[A-Za-z]")


@rule("prefix_or_exact")
def prefix_or_exact(value: Column, settings: Settings) -> Column:
    upper = F.upper(t.compact(value))
    return F.array_contains("allowed_exact", F.upper(t.comparable(value))) | F.exists("prefixes", lambda p: upper.startswith(p))


@rule("regex")
def regex(value: Column, settings: Settings) -> Column:
    pattern = F.col("params.pattern")
    return F.rlike(t.for_pattern(value, pattern), F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


@rule("same_day")
def same_day(value: Column, settings: Settings) -> Column:
    return t.date_text(value) == settings.today


@rule("digit_length")
def digit_length(value: Column, settings: Settings) -> Column:
    return F.array_contains("lengths", F.length(F.regexp_replace(value, "[^0-9]", "")))


@rule("number_less_than")
def number_less_than(value: Column, settings: Settings) -> Column:
    return first_number(value) < F.col("params.max")


@rule("present", "present_and_match", "exact_text_or_ocr_match")
def present(value: Column, settings: Settings) -> Column:
    return value != ""


@rule("optional")
def optional(value: Column, settings: Settings) -> Column:
    return F.lit(True)


def passed(value: Column, settings: Settings) -> Column:
    """Whether the value passes the field's rule; an unknown rule fails, and so does one that lacks a parameter."""
    verdict = F.when(F.lit(False), False)
    for name, made in REGISTRY.items():
        verdict = verdict.when(F.col("validator") == name, made(value, settings))
    return F.coalesce(verdict.otherwise(False), F.lit(False))


def validate(recognitions: DataFrame, settings: Settings) -> DataFrame:
    """Adds passed and message to recognitions that carry their field's catalogue columns."""
    df = computed_once(recognitions.withColumn("__value", t.normalized(t.first_filled(F.col("normalized_value"), F.col("value")))), "__value")
    df = computed_once(df.withColumn("passed", passed(F.col("__value"), settings)).drop("__value"), "passed")
    return df.withColumn("message", F.when(F.col("passed"), "").otherwise(F.col("fail_msg")))
