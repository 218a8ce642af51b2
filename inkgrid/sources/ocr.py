"""Text blocks from recogniser output, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT = "struct<ocrResults:array<struct<prunedResult:struct<rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<double>>>,ocrImage:string>>>"
#: Where blocks come from that don't say it.
SOURCE = "ppocrv6"
BLOCKS = "page_id string, block_seq int, block_id string, text string, score double, x1 double, y1 double, x2 double, y2 double, cx double, cy double, source string"


def read_results(spark: SparkSession, path: str, page: str = "_metadata.file_path") -> DataFrame:
    """Recogniser JSON lines as (page_id, record_no, result); one file is one page, blank lines are skipped."""
    rows = spark.read.schema(f"result {RESULT}").json(path)
    rows = rows.filter("result is not null").withColumn("page_id", F.expr(page))
    return rows.withColumn("record_no", F.row_number().over(Window.partitionBy("page_id").orderBy(F.expr("_metadata.file_block_start"), F.monotonically_increasing_id())))


def blocks(results: DataFrame, source: str = SOURCE) -> DataFrame:
    """(page_id, record_no, result) to blocks: texts, scores and boxes side by side, as far as all three go.

    Empty texts are left out and not counted; ids number what is left of a page, b0000 on; a missing score is 0.
    """
    rows = results.select("page_id", "record_no", F.posexplode("result.ocrResults").alias("ocr_no", "ocr"))
    rows = rows.select("page_id", "record_no", "ocr_no", "ocr.prunedResult.*")
    size = F.least(*[F.size(c) for c in ("rec_texts", "rec_scores", "rec_boxes")])
    cut = lambda c: F.slice(F.col(c), F.lit(1), F.greatest(size, F.lit(0))).alias(c)
    rows = rows.select("page_id", "record_no", "ocr_no", F.posexplode(F.arrays_zip(cut("rec_texts"), cut("rec_scores"), cut("rec_boxes"))).alias("pos", "b"))
    rows = rows.filter("b.rec_texts <> ''")
    order = Window.partitionBy("page_id").orderBy("record_no", "ocr_no", "pos")
    side = [F.get("b.rec_boxes", F.lit(k)) for k in range(4)]
    return rows.select(
        "page_id",
        (F.row_number().over(order) - 1).alias("block_seq"),
        F.format_string("b%04d", F.row_number().over(order) - 1).alias("block_id"),
        F.col("b.rec_texts").alias("text"),
        F.coalesce("b.rec_scores", F.lit(0.0)).alias("score"),
        *[c.alias(n) for c, n in zip(side, ("x1", "y1", "x2", "y2"))],
        ((side[0] + side[2]) / 2.0).alias("cx"),
        ((side[1] + side[3]) / 2.0).alias("cy"),
        F.lit(source).alias("source"),
    )


def text_rows(results: DataFrame) -> DataFrame:
    """As blocks(), with empty texts and without ids: for looking at raw output."""
    rows = results.select("page_id", "record_no", F.posexplode("result.ocrResults").alias("ocr_no", "ocr")).select("page_id", "record_no", "ocr_no", "ocr.prunedResult.*")
    rows = rows.select("page_id", "record_no", "ocr_no", F.posexplode(F.arrays_zip("rec_texts", "rec_scores", "rec_boxes")).alias("pos", "b"))
    return rows.select("page_id", "record_no", "ocr_no", "pos", F.col("b.rec_texts").alias("text"), F.col("b.rec_scores").alias("score"), F.col("b.rec_boxes").alias("box"))


def image_urls(results: DataFrame) -> DataFrame:
    """page_id, page_no, url of the recogniser's own page images, numbered whether or not they have a url."""
    rows = results.select("page_id", "record_no", F.posexplode("result.ocrResults").alias("ocr_no", "ocr"))
    order = Window.partitionBy("page_id").orderBy("record_no", "ocr_no")
    rows = rows.withColumn("page_no", F.row_number().over(order) - 1)
    return rows.filter("ocr.ocrImage <> ''").select("page_id", "page_no", F.col("ocr.ocrImage").alias("url"))


LAYOUT = "struct<layoutParsingResults:array<struct<markdown:struct<text:string>,outputImages:map<string,string>>>>"


def layout_pages(results: DataFrame) -> DataFrame:
    """(page_id, record_no, result of LAYOUT) to page_id, page_no, markdown, images (name to url)."""
    rows = results.select("page_id", "record_no", F.posexplode("result.layoutParsingResults").alias("pos", "p"))
    order = Window.partitionBy("page_id").orderBy("record_no", "pos")
    return rows.select("page_id", (F.row_number().over(order) - 1).alias("page_no"), F.coalesce("p.markdown.text", F.lit("")).alias("markdown"), F.col("p.outputImages").alias("images"))


def block_json(blocks: DataFrame) -> DataFrame:
    """page_id, block_seq, json of each block."""
    box, center = F.array("x1", "y1", "x2", "y2").alias("box"), F.array("cx", "cy").alias("center")
    return blocks.select("page_id", "block_seq", F.to_json(F.struct(F.col("block_id").alias("id"), "text", "score", box, center, "source")).alias("json"))


def blocks_from_json(rows: DataFrame) -> DataFrame:
    """The blocks of block_json; a missing middle is computed, a missing score is 0."""
    parsed = rows.withColumn("b", F.from_json("json", "id string, text string, score double, box array<double>, center array<double>, source string"))
    x1, y1, x2, y2 = (F.get("b.box", F.lit(k)) for k in range(4))
    return parsed.select(
        "page_id", "block_seq", F.col("b.id").alias("block_id"), "b.text", F.coalesce("b.score", F.lit(0.0)).alias("score"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        F.coalesce(F.get("b.center", F.lit(0)), (x1 + x2) / 2).alias("cx"), F.coalesce(F.get("b.center", F.lit(1)), (y1 + y2) / 2).alias("cy"), F.coalesce("b.source", F.lit(SOURCE)).alias("source"),
    )
