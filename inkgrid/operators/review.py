"""Which values a second look is worth, within a budget, and what the second look changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import geometry as g
from inkgrid.functions import text as t
from inkgrid.functions.once import computed_once
from inkgrid.operators import rules
from inkgrid.operators.clean import READING, normal_value, one_of_each

NUMERIC_RULES = ("digit_length", "int_range", "number_less_than")
HIGH_RISK = "授权号|执照号|APU|滑油|签名"
AMBIGUOUS = "存在相近数字候选，等待ROI复核"


def flag(name: str) -> Column:
    return F.coalesce(F.col(f"assignment.{name}"), F.lit(False))


def has_value() -> Column:
    return t.first_filled(F.col("normalized_value"), F.col("value")) != ""


def ambiguity(cands: Column) -> Column:
    """A reason for review if the two best bare numbers differ and score alike; else empty."""
    numbers = F.filter(F.slice(cands, 1, 4), lambda c: t.is_number(c["text"]))
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    alike = second["cand_score"] / F.greatest(first["cand_score"], F.lit(0.001)) >= F.coalesce("assignment.ambiguity_score_ratio", F.lit(0.68))
    asked = F.col("validator").isin(*NUMERIC_RULES) & (F.col("section").isin("oil", "apu") | flag("ambiguity_review"))
    return F.when(asked & (F.size(numbers) >= 2) & (t.compact(first["text"]) != t.compact(second["text"])) & alike, AMBIGUOUS).otherwise("")


def with_ambiguity(rows: DataFrame) -> DataFrame:
    rows = computed_once(rows.withColumn("__why", ambiguity(F.col("cands"))), "__why")
    rows = rows.withColumn("needs_review", F.col("needs_review") | (F.col("__why") != ""))
    return rows.withColumn("review_reason", t.first_filled(F.col("review_reason"), F.col("__why"))).drop("__why")


def wants_review(settings: Settings) -> Column:
    """Whether policy asks for a second look at a checked value; the first matching line decides."""
    numeric, rule = F.col("validator").isin(*NUMERIC_RULES), F.col("validator")
    return (
        F.when(F.lit(settings.review_mode == "roi_only") | (F.col("recognizer") == "checkbox"), False)
        .when(flag("roi_review_always"), True)
        .when(F.col("needs_review") & numeric, True)
        .when(F.col("passed"), False)
        .when(flag("skip_roi_review"), False)
        .when(flag("prefer_roi_vlm") | flag("roi_review"), True)
        .when(numeric | (rule == "regex"), True)
        .when(~has_value() & rule.isin("exact_text", "same_day", "name_not_place", "present"), True)
        .otherwise(False)
    )


def priority() -> Column:
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    by_rule = F.when(F.col("validator").isin("regex", *NUMERIC_RULES), 30).when(F.col("validator") == "same_day", 15).otherwise(0)
    return add(~F.col("passed"), 100) + add(F.col("label").rlike(HIGH_RISK), 80) + by_rule + add(F.col("needs_review"), 40) + add(~has_value(), 20)


def budgeted(checks: DataFrame, settings: Settings) -> DataFrame:
    """Adds eligible, priority, review_turn (in a page, by priority) and selected (within the page's budget)."""
    checks = computed_once(checks.withColumns({"eligible": wants_review(settings), "priority": priority()}), "eligible", "priority")
    turn = Window.partitionBy("page_id", "eligible").orderBy(F.desc("priority"), "field_seq")
    checks = checks.withColumn("review_turn", F.when(F.col("eligible"), F.row_number().over(turn)))
    within = F.lit(True) if settings.reviews == 0 else F.col("review_turn") <= settings.reviews
    return checks.withColumn("selected", F.col("eligible") & within)


def plan(checks: DataFrame, settings: Settings) -> DataFrame:
    """page_id, max_fields, counts and the items selected and skipped, by turn."""
    item = F.struct("review_turn", "field_id", "label", "priority", F.col("passed").alias("passed_before_review"), F.col("review_reason").alias("reason"))
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, item)))
    skipped = F.col("eligible") & ~F.col("selected")
    return checks.groupBy("page_id").agg(
        F.lit(settings.reviews).alias("max_fields"),
        F.count_if("eligible").alias("eligible_count"),
        F.count_if("selected").alias("selected_count"),
        F.count_if(skipped).alias("skipped_count"),
        listed(F.col("selected")).alias("selected_items"),
        listed(skipped).alias("skipped_items"),
    )


_READING = {"__seen": "boolean", "__confidence": "double"} | dict.fromkeys(("__value", "__normalized_value", "__provider", "__model", "__error"), "string")


def merge(checks: DataFrame, reviews: DataFrame | None, settings: Settings) -> DataFrame:
    """Takes a second reading (page_id, field_id, value, normalized_value, confidence, provider, model, error) of selected values into account.

    A reading that passes with enough confidence replaces the value; one that passes without leaves it and says so; one that
    fails leaves it. A selected value without a reading lacks its image. Of several readings of a field one counts, as
    clean.one_of_each has it. Adds reviewed, accepted, changed.
    """
    if reviews is None:
        rows = checks.withColumns({c: F.lit(None).cast(kind) for c, kind in _READING.items()})
    else:
        new = one_of_each(reviews, (*READING, "provider", "model")).withColumn("__seen", F.lit(True))
        rows = checks.join(new, ["page_id", "field_id"], "left")
    rows = computed_once(rows.withColumn("__normal", normal_value(t.first_filled(F.col("__normalized_value"), F.col("__value")))), "__normal")
    seen = F.col("selected") & F.coalesce("__seen", F.lit(False))
    fault = seen & F.col("__error").isNotNull()
    rows = computed_once(rows.withColumn("__read", t.normalized(t.first_filled(F.col("__normal"), F.col("__value")))), "__read")
    rows = computed_once(rows.withColumn("__passed", rules.passed(F.col("__read"), settings)), "__passed")
    sure = F.coalesce("__confidence", F.lit(0.0)) >= settings.confidence
    before, after = t.compact(t.first_filled(F.col("normalized_value"), F.col("value"))), t.compact(t.first_filled(F.col("__normal"), F.col("__value")))
    rows = rows.withColumns(
        {
            "reviewed": seen & ~fault,
            "accepted": seen & ~fault & F.col("__passed") & sure,
            "__unsure": seen & ~fault & F.col("__passed") & ~sure,
            "changed": seen & ~fault & (before != "") & (after != "") & (before != after),
            "review_skipped": F.col("eligible") & ~F.col("selected"),
        }
    )
    low = f"ROI复核置信度低于{settings.confidence:.2f}，需人工确认"
    kept = lambda c: t.first_filled(F.col("review_reason"), F.lit(c))
    reason = (
        F.when(F.col("accepted"), "ROI复核通过")
        .when(F.col("__unsure"), low)
        .when(F.col("reviewed"), kept("ROI复核未通过"))
        .when(fault, kept("ROI复核异常"))
        .when(F.col("selected"), kept("缺少ROI复核图"))
        .otherwise(F.col("review_reason"))
    )
    take = lambda c, n: F.when(F.col("accepted"), n).otherwise(F.col(c))
    rows = rows.withColumns(
        {
            "review_reason": reason,
            "needs_review": F.when(F.col("accepted"), False).otherwise(F.col("needs_review") | F.col("selected")),
            "passed": F.col("passed") | F.col("accepted"),
            "value": take("value", F.col("__value")),
            "normalized_value": take("normalized_value", F.col("__normal")),
            "confidence": take("confidence", F.col("__confidence")),
            "provider": take("provider", F.concat(F.lit("roi-vlm:"), F.coalesce("__provider", F.lit("")))),
            "model": take("model", F.col("__model")),
        }
    )
    rows = rows.withColumn("message", F.when(F.col("passed"), "").otherwise(F.col("message")))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def evidence_boxes(rows: DataFrame, settings: Settings) -> DataFrame:
    """page_id, field_id and the image box (x, y, w, h) that shows a field's evidence; rows carry page_w, page_h, image_w, image_h, cands.

    The oil row's own block; else the field's box, a little widened, where precision counts; else what the first four
    candidates cover; else the field's box, widened more.
    """
    kind, rule, cands = F.col("assignment.value_type"), F.col("validator"), F.col("cands")
    where = F.when(F.coalesce("assignment.evidence_bbox", F.lit("field")) == "search", F.col("target")).otherwise(F.col("bbox"))
    base = g.scaled(where["x"], where["y"], where["w"], where["h"], F.col("page_w") / F.lit(float(settings.page_width)), F.col("page_h") / F.lit(float(settings.page_height)))
    first = F.get(cands, F.lit(0))
    own = (F.col("section") == "oil") & (kind == "numeric") & (first["reason"] == "oil_pf_row_sequence")
    numeric = F.coalesce((kind == "numeric") | rule.isin("digit_length", "int_range"), F.lit(False))
    precise = flag("roi_review_always") | flag("roi_review") | flag("prefer_roi_vlm") | F.coalesce(kind.isin("numeric", "date") | rule.isin("int_range", "number_less_than"), F.lit(False))
    share = F.least(F.greatest(F.coalesce("assignment.roi_expand", F.lit(0.25)), F.lit(0.0)), F.lit(0.6))
    four = F.slice(cands, 1, 4)
    over = lambda f, c: f(F.transform(four, lambda b: b[c].cast("double")))
    choices = (
        (own, g.widened(tuple(first[c] for c in ("x1", "y1", "x2", "y2")), *[F.lit(0.3)] * 4, least=1.0)),
        (precise & numeric, g.widened(base, F.lit(0.03), F.lit(0.08), F.lit(0.24), F.lit(0.08), least=1.0)),
        (precise, g.widened(base, share, share, share, share, least=1.0)),
        (F.size(cands) > 0, g.widened((over(F.array_min, "x1"), over(F.array_min, "y1"), over(F.array_max, "x2"), over(F.array_max, "y2")), *[F.lit(0.55)] * 4, least=1.0)),
        (F.lit(True), g.widened(base, *[F.lit(0.35)] * 4, least=1.0)),
    )
    box = tuple(F.coalesce(*[F.when(cond, made[k].cast("double")) for cond, made in choices]) for k in range(4))
    rows = rows.withColumns({f"__b{k}": c for k, c in enumerate(box)})
    made = g.to_image(tuple(F.col(f"__b{k}") for k in range(4)), F.col("image_w"), F.col("image_h"), F.col("page_w"), F.col("page_h"))
    return rows.select("page_id", "field_id", *[c.alias(k) for k, c in made.items()])
