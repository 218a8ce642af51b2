"""From checked values to a short list of issues: risk, ranking, budget, and which field a problem is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import text as t
from inkgrid.functions.once import computed_once

RISKY_LABEL = "授权号|执照号|APU|滑油|日期"
PLAIN_REASONS = ("需人工复核", "needs_review")


def risk_score() -> Column:
    add = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    by_rule = (
        F.when(F.col("validator").isin("regex", "digit_length", "same_day", "number_less_than"), 80)
        .when(F.col("validator") == "int_range", 70)
        .when(F.col("validator").isin("exact_text", "exact_text_or_ocr_match", "name_not_place"), 45)
        .otherwise(0)
    )
    signed = F.col("label").contains("签") | (F.col("recognizer") == "signature_or_text")
    return (
        by_rule + add(signed, 60) + add(F.col("label").rlike(RISKY_LABEL), 35) + add(F.col("needs_review"), 12)
        + add(F.col("reviewed"), 20) + add(F.col("reviewed") & F.col("changed"), 12) + add(F.col("review_skipped"), 18)
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 130, "high").when(score >= 80, "medium").otherwise("low")


def evidence_state() -> Column:
    return (
        F.when(F.col("reviewed") & F.col("changed"), "roi_reviewed_changed")
        .when(F.col("reviewed"), "roi_reviewed")
        .when(F.col("review_skipped"), "roi_review_skipped")
        .when(F.col("needs_review"), "needs_review")
        .when(F.col("confidence").isNotNull(), "ocr_cleaned")
        .otherwise("unknown")
    )


def review_state() -> Column:
    return F.when(F.col("needs_review"), t.first_filled(F.col("review_reason"), F.lit("needs_review"))).otherwise("not_requested")


def review_message() -> Column:
    label = t.strip(t.first_filled(F.nullif(F.col("label"), F.lit("")), F.col("field_id")))
    reason = t.strip(F.col("review_reason"))
    plain = (reason == "") | reason.isin(*PLAIN_REASONS)
    return F.concat(label, F.lit("需复核"), F.when(plain, "").otherwise(F.concat(F.lit("："), reason)))


def with_risk(checks: DataFrame) -> DataFrame:
    checks = computed_once(checks.withColumn("risk", risk_score()), "risk")
    return checks.withColumns({"risk_level": risk_level(F.col("risk")), "evidence_state": evidence_state(), "review_state": review_state()})


def with_kind(checks: DataFrame) -> DataFrame:
    """Adds kind and text: failures with a message (0) and passed values that need review (1); null for what is no issue."""
    kind = F.when(~F.col("passed"), 0).when(F.col("needs_review"), 1)
    text = F.when(F.col("passed"), review_message()).otherwise(F.col("message"))
    rows = computed_once(with_risk(checks).withColumns({"kind": kind, "text": text}), "kind", "text")
    return rows.withColumn("kind", F.when(F.col("text") != "", F.col("kind")))


def issues(checks: DataFrame) -> DataFrame:
    """The issues of with_kind, ranked in their kind of a page."""
    rank = Window.partitionBy("page_id", "kind").orderBy(F.desc("risk"), "label", "field_seq")
    return with_kind(checks).filter("kind is not null").withColumn("kind_rank", F.row_number().over(rank))


def _in_order() -> Column:
    """The place of a row among its page's: failures first, then review items, each by risk; what is no issue comes last."""
    return F.row_number().over(Window.partitionBy("page_id").orderBy(F.asc_nulls_last("kind"), F.desc("risk"), "label", "field_seq"))


def with_slots(checks: DataFrame) -> DataFrame:
    """All checks with kind, text and slot, the place among the page's issues (null for what is no issue)."""
    rows = with_kind(checks).withColumn("slot", _in_order())
    return rows.withColumn("slot", F.when(F.col("kind").isNotNull(), F.col("slot")))


def top_issues(checks: DataFrame, settings: Settings) -> DataFrame:
    """The issues shown for each page, in order: failures first, review items in the slots left."""
    rows = with_kind(checks).filter("kind is not null").withColumn("slot", _in_order()).filter(F.col("slot") <= settings.issues)
    return rows.select("page_id", "slot", "kind", "text", "field_id", "field_seq", "label", "risk", "risk_level", "evidence_state")


def suppressed(checks: DataFrame, settings: Settings) -> DataFrame:
    """Issues of which no shown one has the text."""
    shown = top_issues(checks, settings).select("page_id", "text").distinct()
    return issues(checks).join(shown, ["page_id", "text"], "left_anti").select("page_id", "kind", "kind_rank", "text", "field_id")


def attributed(problems: DataFrame, checks: DataFrame) -> DataFrame:
    """Finds the field that each problem text (page_id, pos, text) is about: by its message, else by its label, else none.

    A match is equality or containment either way, without white space and case; failures come before review items, each in the
    catalogue's order. Problems are joined to the issues of their own page only.
    """
    known = issues(checks).select("page_id", "kind", "field_seq", "field_id", "label", "risk_level", "evidence_state", t.problem_key(F.col("text")).alias("own"))
    wanted = problems.withColumn("key", t.problem_key(F.col("text")))
    rows = wanted.join(known, "page_id", "left")
    label, bare = t.problem_key(F.col("label")), t.problem_key(t.without_index(F.col("label")))
    key, own = F.col("key"), F.col("own")
    by_text = (key == own) | ((own != "") & (own.contains(key) | key.contains(own)))
    by_label = ((label != "") & key.contains(label)) | ((bare != "") & key.contains(bare))
    step = F.when(by_text, 1).when(by_label, 2)
    best = F.min(F.when(step.isNotNull(), F.struct(step.alias("step"), "kind", "field_seq", "field_id", "label", "risk_level", "evidence_state")))
    rows = rows.groupBy("page_id", "pos", "text").agg(best.alias("b"))
    pick = lambda c, d: F.coalesce(F.col(f"b.{c}"), F.lit(d)).alias(c)
    kind = F.when(F.col("b.kind") == 0, "failure").when(F.col("b.kind") == 1, "review").otherwise("summary").alias("kind")
    return rows.select("page_id", "pos", "text", pick("field_id", ""), pick("label", ""), kind, pick("risk_level", "low"), pick("evidence_state", "summary"))


def requests(checks: DataFrame) -> DataFrame:
    """page_id, payload: the issues that a model may choose from, as JSON."""
    entry = F.struct(
        "field_seq", F.col("field_id").alias("id"), "label", F.when(F.col("kind") == 0, "failure").otherwise("review_pending").alias("kind"), F.col("text").alias("message"),
        t.first_filled(F.col("normalized_value"), F.col("value")).alias("value"), "validator", "confidence", "risk_level", F.col("risk").alias("risk_score"), "evidence_state", "review_state",
    )
    return issues(checks).groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))


def accepted_items(items: DataFrame, checks: DataFrame, settings: Settings) -> DataFrame:
    """Items (page_id, pos, field_id, kind, text) of a model's answer that name a known issue of the right kind: first of a field, up to the limit."""
    known = issues(checks).select("page_id", F.col("field_id"), F.col("kind").alias("own_kind"), F.col("text").alias("own_text"), "label", "risk_level", "evidence_state")
    rows = items.withColumn("field_id", t.strip(F.col("field_id"))).join(known, ["page_id", "field_id"])
    said = F.lower(t.strip(F.col("kind")))
    wrong = ((F.col("own_kind") == 0) & said.isin("review", "review_pending", "needs_review")) | ((F.col("own_kind") == 1) & said.isin("failure", "fail", "failed"))
    rows = rows.filter(~wrong).withColumn("text", t.first_filled(t.strip(F.col("text")), F.col("own_text"))).filter("text <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "field_id").orderBy("pos"))).filter("n = 1")
    rows = rows.withColumn("slot", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("slot") <= settings.issues)
    return rows.select("page_id", "slot", "text", "field_id", "label", F.when(F.col("own_kind") == 0, "failure").otherwise("review").alias("kind"), "risk_level", "evidence_state")


def chosen(items: DataFrame, checks: DataFrame, settings: Settings) -> DataFrame:
    """The issues shown: those that accepted_items takes of a model's answer, by rule for pages of which it takes none.

    Both are told from one ranking of the issues, so that checks are worked out once.
    """
    ranked = with_slots(checks).filter("slot is not null").select("page_id", "field_id", F.col("kind").alias("own_kind"), F.col("text").alias("own_text"), "label", "risk_level", "evidence_state", F.col("slot").alias("own_slot"))
    rows = ranked.join(items.withColumn("field_id", t.strip(F.col("field_id"))), ["page_id", "field_id"], "left")
    said = F.lower(t.strip(F.col("kind")))
    wrong = ((F.col("own_kind") == 0) & said.isin("review", "review_pending", "needs_review")) | ((F.col("own_kind") == 1) & said.isin("failure", "fail", "failed"))
    rows = rows.withColumn("__pos", F.when(~wrong, F.col("pos")))
    one = F.row_number().over(Window.partitionBy("page_id", "field_id").orderBy(F.asc_nulls_last("__pos")))
    rows = rows.withColumn("__n", one).filter("__n = 1")
    page, place = Window.partitionBy("page_id"), Window.partitionBy("page_id").orderBy(F.asc_nulls_last("__pos"), "own_slot")
    rows = rows.withColumn("__any", F.min("__pos").over(page).isNotNull()).withColumn("slot", F.row_number().over(place))
    rows = rows.filter((F.col("slot") <= settings.issues) & (~F.col("__any") | F.col("__pos").isNotNull()))
    text = F.when(F.col("__any"), t.first_filled(t.strip(F.col("text")), F.col("own_text"))).otherwise(F.col("own_text")).alias("text")
    return rows.select("page_id", "slot", text, "field_id", "label", F.when(F.col("own_kind") == 0, "failure").otherwise("review").alias("kind"), "risk_level", "evidence_state")
