"""What candidates of different fields have to do with each other: shared evidence and the oil row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import geometry as g
from inkgrid.functions import text as t
from inkgrid.operators.match import BLOCK_COLUMNS, with_extent
from inkgrid.sources.catalog import OIL_ROW

ROUNDS = 3
MAY_SHARE = ("bilingual_text", "english_text")


def resolve_conflicts(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """No block stays the first evidence of several fields: the best score keeps it, other fields lose that candidate.

    A round looks at the state at its start; three rounds at most. What was cut to the best few before is not filled up.
    """
    by_field = Window.partitionBy("page_id", "field_id").orderBy("rank")
    contest = Window.partitionBy("page_id", "block_id").orderBy(F.desc("claims"), F.desc("cand_score"), "field_seq")
    now = candidates
    for k in range(rounds):
        # Candidates come with their field's ranks from 1, which hold until some are lost.
        now = now.withColumn("rank", F.row_number().over(by_field)) if k else now
        claims = (F.col("rank") == 1) & ~F.col("validator").isin(*MAY_SHARE)
        # Claims on a block come first in its order, so a claim behind another claim has lost it.
        now = now.withColumn("claims", claims.cast("int")).withColumn("turn", F.row_number().over(contest))
        now = now.filter((F.col("claims") == 0) | (F.col("turn") == 1)).drop("claims", "turn")
    return now.withColumn("rank", F.row_number().over(by_field))


def oil_row(blocks: DataFrame, fields: DataFrame, settings: Settings) -> DataFrame:
    """page_id, field_id, block columns: the bottom row of bare numbers in the oil region, read from left to right.

    Needs all five oil fields, three numbers in the region and three in the row. Rows form from top to bottom: a number
    joins the first row whose mean middle is within 0.7 of the taller height.
    """
    oil = fields.coalesce(1).filter(F.col("field_id").isin(*OIL_ROW))
    target = F.broadcast(oil.agg(F.size(F.collect_set("field_id")).alias("known"), *(f(e).alias(n) for n, f, e in (("rx1", F.min, F.col("target.x")), ("ry1", F.min, F.col("target.y")), ("rx2", F.max, F.col("target.x") + F.col("target.w")), ("ry2", F.max, F.col("target.y") + F.col("target.h"))))))
    spots = with_extent(blocks).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2.0, "cy": (F.col("y1") + F.col("y2")) / 2.0})
    spots = spots.join(target, F.col("known") == len(OIL_ROW))
    sx, sy = F.col("page_w") / F.lit(settings.page_width), F.col("page_h") / F.lit(settings.page_height)
    region = (F.col("rx1") * sx, F.col("ry1") * sy, F.col("rx2") * sx, F.col("ry2") * sy)
    region = g.widened(region, F.lit(0.25), F.lit(0.15), F.lit(0.25), F.lit(0.35), least=1.0)
    numbers = spots.filter(t.is_number(F.col("text")) & g.inside(F.col("cx"), F.col("cy"), region))
    entry = F.struct("cy", "block_seq", F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)).cast("double").alias("h"), "cx", *[F.col(c) for c in ("block_id", "text", "score", "x1", "y1", "x2", "y2")])
    pages = numbers.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("numbers")).filter(F.size("numbers") >= 3)
    kind = pages.schema["numbers"].dataType.simpleString()

    def mean(row):
        return F.aggregate(row, F.lit(0.0), lambda s, b: s + b["cy"]) / F.size(row)

    def fits(row, b):
        tallest = F.greatest(b["h"], F.array_max(F.transform(row, lambda x: x["h"])))
        return F.abs(b["cy"] - mean(row)) <= tallest * 0.7

    def placed(rows, b):
        where = F.transform(rows, lambda row: fits(row, b))
        at = F.array_position(where, True)
        joined = F.transform(rows, lambda row, k: F.when(k == at - 1, F.concat(row, F.array(b))).otherwise(row))
        return F.when(at > 0, joined).otherwise(F.concat(rows, F.array(F.array(b))))

    rows = F.aggregate("numbers", F.array().cast(f"array<{kind}>"), placed)
    ranked = F.array_max(F.transform(rows, lambda row, k: F.struct(mean(row).alias("m"), F.size(row).alias("n"), (-k).alias("k"), row.alias("r"))))["r"]
    pages = pages.select("page_id", ranked.alias("r")).filter(F.size("r") >= 3)
    left_right = F.array_sort(F.transform("r", lambda b: F.struct(b["cx"].alias("cx"), b["block_seq"].alias("seq"), b.alias("block"))))
    order = F.array(*[F.lit(x) for x in OIL_ROW])
    found = pages.select("page_id", F.posexplode(F.slice(left_right, 1, len(OIL_ROW))).alias("pos", "b"))
    return found.select("page_id", F.get(order, F.col("pos")).alias("field_id"), *[F.col(f"b.block.{c}").alias(c) for c in BLOCK_COLUMNS[1:]])


def with_oil_row(candidates: DataFrame, row: DataFrame, fields: DataFrame, settings: Settings) -> DataFrame:
    """Puts the oil row's blocks in front of their fields' candidates, without a second entry of the same block."""
    keys = ["page_id", "field_id"]
    known = F.broadcast(fields.select("field_id", "field_seq", "validator"))
    first = row.join(known, "field_id").withColumns({"rank": F.lit(0), "cand_score": F.col("score") + 4.0, "reason": F.lit("oil_pf_row_sequence")})
    every = candidates.unionByName(first.select(*candidates.columns))
    again = Window.partitionBy(*keys, "block_id").orderBy("rank")
    every = every.withColumn("again", F.row_number().over(again)).filter("again = 1").drop("again")
    order = Window.partitionBy(*keys).orderBy("rank")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.max_candidates)
