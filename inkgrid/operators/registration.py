"""Whether a page's homography makes sense, as arithmetic on nine numbers; the estimation itself happens elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_AREA, MOST_AREA, MOST_STRETCH, FLAT = 0.35, 2.5, 2.2, 1e-8
LEAST_INLIERS, MOST_ERROR = 70, 3.5


def mapped(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Where a point goes."""
    depth = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / depth, (h[3] * x + h[4] * y + h[5]) / depth


def judged(pages: DataFrame, template_width: int, template_height: int) -> DataFrame:
    """Adds area_ratio, convex, stretch and reject_reason (empty: fine) to pages (width, height, homography, inliers, rmse).

    The quadrilateral of the mapped corners must cover a fitting area and be convex, and the linear part must neither
    collapse nor stretch; then inliers and error are asked.
    """
    h = [F.col("homography")[r][c] for r in range(3) for c in range(3)]
    right, bottom, zero = (F.col("width") - 1).cast("double"), (F.col("height") - 1).cast("double"), F.lit(0.0)
    corner = [mapped(h, x, y) for x, y in ((zero, zero), (right, zero), (right, bottom), (zero, bottom))]
    rows = pages.withColumns({f"__{axis}{k}": c[a] for k, c in enumerate(corner) for a, axis in enumerate("xy")})
    p = [(F.col(f"__x{k}"), F.col(f"__y{k}")) for k in range(4)]
    area = F.abs(sum((p[k][0] * p[(k + 1) % 4][1] - p[(k + 1) % 4][0] * p[k][1] for k in range(4)), F.lit(0.0))) / 2
    turn = [(p[(k + 1) % 4][0] - p[k][0]) * (p[(k + 2) % 4][1] - p[(k + 1) % 4][1]) - (p[(k + 1) % 4][1] - p[k][1]) * (p[(k + 2) % 4][0] - p[(k + 1) % 4][0]) for k in range(4)]
    convex = (F.least(*turn) > 0) | (F.greatest(*turn) < 0)
    square, det = h[0] * h[0] + h[1] * h[1] + h[3] * h[3] + h[4] * h[4], h[0] * h[4] - h[1] * h[3]
    spread = F.sqrt(F.greatest(square * square - 4 * det * det, F.lit(0.0)))
    large, small = F.sqrt((square + spread) / 2), F.sqrt(F.greatest((square - spread) / 2, F.lit(0.0)))
    rows = rows.withColumns({"area_ratio": area / F.lit(float(template_width * template_height)), "convex": convex, "stretch": F.when(small > FLAT, large / small)})
    reason = (
        F.when(~F.col("area_ratio").between(LEAST_AREA, MOST_AREA), "area_ratio")
        .when(~F.col("convex"), "quad_not_convex")
        .when(F.col("stretch").isNull(), "singular_homography")
        .when(F.col("stretch") > MOST_STRETCH, "anisotropy")
        .when(F.col("inliers") < LEAST_INLIERS, "inliers")
        .when(F.col("rmse") > MOST_ERROR, "rmse")
        .otherwise("")
    )
    return rows.withColumn("reject_reason", reason).drop(*[f"__{axis}{k}" for k in range(4) for axis in "xy"])


def record(pages: DataFrame, mode: str) -> DataFrame:
    """page_id and `registration`, as JSON: what judged() says of a page; pages without a homography were not registered."""
    tried = F.col("homography").isNotNull()
    made = F.struct(
        F.lit(mode).alias("mode"), tried.alias("enabled"), (tried & (F.col("reject_reason") == "")).alias("ok"), F.when(tried, F.col("inliers")).otherwise(0).alias("inliers"),
        F.when(tried, F.col("rmse")).alias("reproj_rmse"), F.when(~tried, "REGISTRATION_MODE=off").when(F.col("reject_reason") != "", F.col("reject_reason")).alias("reject_reason"),
        F.col("homography"),
    )
    return pages.select("page_id", F.to_json(made, {"ignoreNullFields": "false"}).alias("registration"))


def ordered_corners(points: Column) -> Column:
    """An array of (x, y) structs as top left, top right, bottom right, bottom left: by x+y and y-x."""
    at = lambda key, end: end(F.transform(points, lambda q: F.struct(key(q).alias("k"), q.alias("q"))))["q"]
    total, lean = (lambda q: q["x"] + q["y"]), (lambda q: q["y"] - q["x"])
    return F.array(at(total, F.array_min), at(lean, F.array_min), at(total, F.array_max), at(lean, F.array_max))
