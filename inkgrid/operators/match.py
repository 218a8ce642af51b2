"""Matching blocks to fields: a broadcast spatial join, a score, and the best few candidates of each field.

Blocks come as (page_id, block_seq, block_id, text, score, x1, y1, x2, y2[, source]). A text is looked at where its block lies at
a field, and only for what that field's rule asks; what depends on a field alone is in the catalogue.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import geometry as g
from inkgrid.functions import text as t
from inkgrid.functions.once import computed_once, dealt

BLOCK_COLUMNS = ("page_id", "block_seq", "block_id", "text", "score", "x1", "y1", "x2", "y2", "cx", "cy")
MARGIN = 1.04
#: A catalogue of more fields is matched by cells of the page, of this side in the catalogue's pixels.
MANY, CELL = 512, 160.0


def page_extent(blocks: DataFrame) -> DataFrame:
    """page_id, page_w, page_h: the largest box ends of a page, a little widened, 1 at least."""
    end = lambda c: F.greatest(F.max(c) * MARGIN, F.lit(1.0))
    return blocks.groupBy("page_id").agg(end("x2").alias("page_w"), end("y2").alias("page_h"))


def with_extent(blocks: DataFrame) -> DataFrame:
    """Blocks with the extent of their page: maxima are taken where the blocks lie and joined back, so that no page is one task's."""
    extent = page_extent(blocks).withColumnRenamed("page_id", "__page")
    return blocks.join(extent, F.col("page_id").eqNullSafe(F.col("__page"))).drop("__page")


def facts() -> SimpleNamespace:
    """What a rule may ask of a pair's `text` and `compact` text. Expressions, not columns: most fields ask one or two of them."""
    text, compact = F.col("text"), F.col("compact")
    return SimpleNamespace(
        upper=F.upper(compact),
        station=F.lower(compact).isin(*t.STATION_SPELLINGS),
        comparable=t.comparable_bare(compact),
        number=t.whole(compact, t.NUMBER),
        value=F.when(compact.rlike(t.DOUBLE), compact.try_cast("double")),
        date=t.is_bare_date(compact),
        date_inside=text.rlike(t.DATE_INSIDE),
        latin=text.rlike("[A-Za-z]"),
        cjk=text.rlike(t.CJK),
        authorization=text.rlike(t.SIX_DIGITS),
        release=t.is_release_statement(text),
    )


def _matches_pattern() -> Column:
    pattern = F.col("params.pattern")
    return pattern.isNotNull() & F.rlike(facts().upper, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def with_label(blocks: DataFrame) -> DataFrame:
    """Adds f_label: whether the text holds words of the form, which no field but a checkbox takes."""
    return computed_once(blocks.withColumn("f_label", t.is_label(F.coalesce("text", F.lit("")))), "f_label")


def vetoed() -> Column:
    """Whether a text that is not noisy can't be this field's value; the kind of value is asked before the rule."""
    kind, rule, says = F.col("assignment.value_type"), F.col("validator"), facts()
    return (
        F.when(kind == "signature", says.station | says.date | says.number | says.release)
        .when(kind == "authorization", ~says.authorization)
        .when(kind == "license", ~says.upper.rlike("CA|[0-9]{4,8}"))
        .when(kind == "text", says.station | says.date)
        .when(rule.isin("int_range", "digit_length", "number_less_than"), ~says.number)
        .when(rule == "same_day", ~says.date_inside)
        .when(rule == "regex", ~_matches_pattern() & ~says.upper.rlike("CAAC|AUTH|授权|[0-9]{6}"))
        .when(rule == "exact_text", (F.size("allowed") > 0) & ~F.array_contains("allowed", says.comparable))
        .otherwise(False)
    )


def pattern_score() -> Column:
    """How well the shape of a text that is neither noisy nor vetoed suits the field, 0 to 1."""
    rule, kind, says = F.col("validator"), F.col("assignment.value_type"), facts()
    upper, number, latin, cjk = says.upper, says.value, says.latin, says.cjk
    by_kind = (
        F.when(kind == "signature", 0.55)
        .when(kind == "authorization", F.when(says.authorization, 0.8).otherwise(0.0))
        .when((kind == "license") & upper.startswith("CAAC"), 0.8)
        .when((kind == "license") & (upper.startswith("CA") | t.whole(upper, "[0-9]{4,8}")), 0.45)
        .otherwise(0.0)
    )
    return (
        F.when(F.col("recognizer") == "checkbox", 0.0)
        .when((rule == "regex") & _matches_pattern(), 1.0)
        .when((rule == "regex") & upper.rlike("CAAC|[0-9]{6}"), 0.65)
        .when((rule == "prefix_or_exact") & (F.array_contains("allowed_exact", F.upper(says.comparable)) | F.exists("prefixes", lambda p: upper.startswith(p))), 1.0)
        .when((rule == "prefix_or_exact") & upper.rlike("AMM|TSM|FLA"), 0.85)
        .when((rule == "prefix_or_exact") & upper.rlike("[A-Z]{2,}[0-9]"), 0.35)
        .when(rule == "same_day", F.when(says.date_inside, 1.0).otherwise(0.0))
        .when(rule == "int_range", F.when(number.between(F.col("params.min"), F.col("params.max")), 1.0).when(number.isNotNull() & F.col("params.min").isNotNull() & F.col("params.max").isNotNull(), 0.08).otherwise(0.0))
        .when(rule.isin("digit_length", "number_less_than"), F.when(says.number, 0.9).otherwise(0.0))
        .when(rule == "bilingual_text", F.when(latin & cjk, 0.9).when(latin | cjk, 0.45).otherwise(0.0))
        .when(rule == "contains_english", F.when(latin, 0.8).otherwise(0.0))
        .when(rule == "english_text", F.when(latin & ~cjk, 0.8).when(latin, 0.35).otherwise(0.0))
        .when((rule == "exact_text") & F.array_contains("allowed", says.comparable), 1.0)
        .when(rule == "name_not_place", F.when((F.col("compact") != "") & ~says.station, 0.6).otherwise(0.0))
        .otherwise(by_kind)
    )


def _cells(low: Column, high: Column) -> Column:
    """The cells of the canonical page that a stretch reaches into; a hair beyond each end, since the two sides are scaled apart."""
    return F.sequence(F.floor((F.least(low, high) - 1e-6) / CELL), F.floor((F.greatest(low, high) + 1e-6) / CELL))


def _in_cells(rows: DataFrame, box: tuple[Column, ...], name: str) -> DataFrame:
    """The rows once for each cell that their box reaches into, with the least of them."""
    rows = rows.withColumns({f"__{name}x": _cells(box[0], box[2]), f"__{name}y": _cells(box[1], box[3])})
    rows = rows.withColumns({f"__{name}x0": F.col(f"__{name}x")[0], f"__{name}y0": F.col(f"__{name}y")[0]})
    rows = rows.withColumn("__cx", F.explode(f"__{name}x")).withColumn("__cy", F.explode(f"__{name}y"))
    return rows.drop(f"__{name}x", f"__{name}y")


def _by_cell(spots: DataFrame, fields: DataFrame, shared: list[str]) -> DataFrame:
    """Blocks and fields that share a cell, each pair once: in the least cell that both reach into."""
    around = F.coalesce("assignment.expand", F.lit(0.18))
    box = g.scaled(F.col("target.x"), F.col("target.y"), F.col("target.w"), F.col("target.h"), F.lit(1.0), F.lit(1.0))
    wide = g.widened(box, around, around, around, around)
    reach = (F.least(box[0], wide[0]), F.least(box[1], wide[1]), F.greatest(box[2], wide[2]), F.greatest(box[3], wide[3]))
    own = (F.col("x1") / F.col("sx"), F.col("y1") / F.col("sy"), F.col("x2") / F.col("sx"), F.col("y2") / F.col("sy"))
    left, right = _in_cells(spots, own, "b"), _in_cells(fields, reach, "f")
    pairs = left.join(right, [*shared, "__cx", "__cy"])
    first = (F.col("__cx") == F.greatest("__bx0", "__fx0")) & (F.col("__cy") == F.greatest("__by0", "__fy0"))
    return pairs.filter(first).drop("__cx", "__cy", "__bx0", "__by0", "__fx0", "__fy0")


def spatial_match(blocks: DataFrame, fields: DataFrame, settings: Settings, by_cell: bool | None = None) -> DataFrame:
    """Every (field, block) pair that overlaps, or is near enough, and is no misfit: overlap, near, distance, pattern.

    A catalogue of some tens of rows is broadcast, and the geometry is the join's condition. One of more than MANY rows, such
    as that of many forms, meets the blocks by equal cells of the page first: no block is held against every field. Where both
    sides have a template_id, only fields of the block's template are asked. Either way gives the same rows.
    """
    shared = [c for c in ("template_id",) if c in blocks.columns and c in fields.columns]
    spots = with_extent(blocks).withColumns({"sx": F.col("page_w") / F.lit(settings.page_width), "sy": F.col("page_h") / F.lit(settings.page_height)})
    # What the geometry asks of a field is worked out for each field, not for each pair.
    ends = (F.col("target.x"), F.col("target.y"), F.col("target.x") + F.col("target.w"), F.col("target.y") + F.col("target.h"))
    fields = fields.withColumns({f"__end{k}": c.cast("double") for k, c in enumerate(ends)} | {"__around": F.coalesce("assignment.expand", F.lit(0.18))})
    box = tuple(F.col(f"__end{k}") * F.col(("sx", "sy")[k % 2]) for k in range(4))
    around = F.col("__around")
    wide = g.widened(box, around, around, around, around)
    block = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    near = g.inside((F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0, wide)
    there = (g.covered(block, box) > 0) | near
    noisy = F.col("f_label") & (F.col("recognizer") != "checkbox")
    if by_cell if by_cell is not None else fields.limit(MANY + 1).count() > MANY:
        pairs = _by_cell(with_label(spots), fields, shared).filter(there & ~noisy)
    else:
        known = F.broadcast(fields.withColumnsRenamed({c: f"__{c}" for c in shared}))
        for c in shared:
            there = (F.col(c) == F.col(f"__{c}")) & there
        # Blocks that lie at no field, as most may, have their texts not looked at.
        pairs = with_label(spots.join(known, there, "left_semi")).join(known, there & ~noisy).drop(*[f"__{c}" for c in shared])
    # Fences keep what follows out of the join's condition, where every block would be asked for every field, and scores from being
    # worked out again in filters on them. What they are made of, texts in steps, is more than the JVM compiles in one piece.
    worked_out = [*[f"__end{k}" for k in range(4)], "__around"]
    made = {f"__box{k}": c for k, c in enumerate(box)} | {"near": near, "text": F.coalesce("text", F.lit("")), "cx": (F.col("x1") + F.col("x2")) / 2.0, "cy": (F.col("y1") + F.col("y2")) / 2.0}
    pairs = computed_once(pairs.withColumns(made).drop("sx", "sy", "page_w", "page_h", *worked_out), *made)
    pairs = computed_once(pairs.withColumn("compact", t.compact(F.col("text"))), "compact").filter(~vetoed())
    box = tuple(F.col(f"__box{k}") for k in range(4))
    made = {"overlap": g.covered(block, box), "distance": g.nearness(F.col("cx"), F.col("cy"), box), "pattern": pattern_score(), "field_y1": box[1], "field_h": F.greatest(box[3] - box[1], F.lit(1.0))}
    return computed_once(pairs.withColumns(made), *made).drop("compact", "f_label", *[f"__box{k}" for k in range(4)])


def scored(pairs: DataFrame) -> DataFrame:
    """Adds cand_score (positive) and reason to matched pairs."""
    c = F.col
    score = c("score") * 0.45 + c("overlap") * 1.5 + c("distance") * 0.45 + c("pattern") * 0.7
    score = score + F.when(c("assignment.value_type").isNotNull() & (c("pattern") > 0), 0.25).otherwise(0.0)
    depth = F.greatest(F.lit(0.0), F.least((c("cy") - c("field_y1")) / c("field_h"), F.lit(1.0))) * 0.55
    score = score + F.when(c("assignment.row") == "last", depth).otherwise(0.0)
    score = score * F.when((c("validator") == "int_range") & (c("pattern") < 0.2), 0.45).otherwise(1.0)
    # A cast rounds halves up, as a format of two places does, and is cheaper.
    part = lambda name: F.when(c(name) > 0, F.concat(F.lit(f"{name}="), c(name).cast("decimal(12,2)").cast("string")))
    reason = F.concat_ws(",", part("overlap"), F.when(c("near"), "center_near"), part("pattern"))
    return pairs.withColumns({"cand_score": score, "reason": reason}).filter("cand_score > 0")


def candidates(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The best candidates of each field of a page, ranked from 1; ties go to the earlier block."""
    best = Window.partitionBy("page_id", "field_id").orderBy(F.desc("cand_score"), "block_seq")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= settings.max_candidates)
    return ranked.select("page_id", "field_seq", "field_id", "validator", "rank", *BLOCK_COLUMNS[1:], "cand_score", "reason")


def match(blocks: DataFrame, fields: DataFrame, settings: Settings) -> DataFrame:
    """Blocks to ranked candidates. What matched is dealt out by page once; all that follows is local to a page."""
    return candidates(dealt(scored(spatial_match(blocks, fields, settings)), "page_id"), settings)
