"""Finished jobs of a recogniser, a row for each page whatever became of it, behind the cache of what was read before.

A job is a folder named like its page, with `job.json` and, where the job went well, `result.jsonl`. A job that failed, that
can't be read or that never ran is a row with an error: nothing a job can hold makes the ingestion fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.functions import text as t
from inkgrid.operators import caches
from inkgrid.sources import ocr

JOB = "ok boolean, job_id string, state string, error string"
ENTRY = "array<struct<id:string,text:string,score:double,box:array<double>,center:array<double>,source:string>>"
# Fixed value: the error of a failed job that says neither why nor in what state it is.
UNSTATED = "ppocr_job_failed"
MISSING, UNREADABLE, NO_RESULT, BROKEN = "no job", "unreadable job.json", "no result.jsonl", "unreadable lines in result.jsonl: "


def _folder(path: str) -> Column:
    return F.element_at(F.split(F.expr(path), "/"), -2)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, lines) of a folder of job folders: page_id, value, has_result, and page_id, line_no, value.

    What has a result is told from the listing of files, not from their content. An empty file counts as none, since Spark's
    readers pass over it; a result without records has a blank line.
    """
    files = lambda name: {"recursiveFileLookup": "true", "pathGlobFilter": name}
    made = spark.read.options(wholetext="true", **files("job.json")).text(path).select(_folder("_metadata.file_path").alias("page_id"), "value")
    held = spark.read.format("binaryFile").options(**files("result.jsonl")).load(path).select(_folder("path").alias("page_id"), F.lit(True).alias("__held"))
    jobs = made.join(held, "page_id", "left").select("page_id", "value", F.coalesce("__held", F.lit(False)).alias("has_result"))
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.options(**files("result.jsonl")).text(path).select(_folder("_metadata.file_path").alias("page_id"), line.alias("line_no"), "value")
    return jobs, lines


def _entries(result: Column) -> Column:
    """The blocks of one record as ENTRY without ids; which texts count is as in ocr.blocks."""

    def of_one(found: Column) -> Column:
        parts = [found["prunedResult"][c] for c in ("rec_texts", "rec_scores", "rec_boxes")]
        size = F.coalesce(F.greatest(F.least(*[F.coalesce(F.size(p), F.lit(0)) for p in parts]), F.lit(0)), F.lit(0))
        cut = F.transform(F.slice(parts[0], F.lit(1), size), lambda text, k: F.struct(text.alias("text"), F.get(parts[1], k).alias("score"), F.get(parts[2], k).alias("box")))
        return F.coalesce(F.filter(cut, lambda b: b["text"] != ""), F.array().cast("array<struct<text:string,score:double,box:array<double>>>"))

    return F.flatten(F.transform(result["ocrResults"], of_one))


def _numbered(found: Column) -> Column:
    """Blocks with ids, missing scores and middles, as ENTRY."""
    side = lambda b, k: F.get(b["box"], F.lit(k))
    center = lambda b: F.array((side(b, 0) + side(b, 2)) / 2.0, (side(b, 1) + side(b, 3)) / 2.0)
    return F.transform(
        found,
        lambda b, k: F.struct(
            F.format_string("b%04d", k).alias("id"), b["text"].alias("text"), F.coalesce(b["score"], F.lit(0.0)).alias("score"), b["box"].alias("box"), center(b).alias("center"), F.lit(ocr.SOURCE).alias("source")
        ),
    )


def envelopes(jobs: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id, ok, error, job_id, blocks (ENTRY) of each job; a job that is not ok has no blocks.

    A job with any line that is no record is broken as a whole: a page read in part would look like an empty form. Blank lines
    don't count. A job without records is ok and has no blocks. Of a page's lines one row is made, in one shuffle by page.
    """
    job = F.from_json("value", f"{JOB}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = jobs.select("page_id", "has_result", job.alias("j"))
    record = F.from_json("value", f"result {ocr.RESULT}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    read_ = lines.filter(t.strip(F.col("value")) != "").select("page_id", "line_no", record.alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    part = F.struct("line_no", _entries(F.col("r.result")).alias("found"))
    held = read_.groupBy("page_id").agg(F.count_if(broken).alias("__broken"), F.array_sort(F.collect_list(F.when(F.col("r.result.ocrResults").isNotNull(), part))).alias("__parts"))
    unreadable = F.col("j").isNull() | F.col("j._broken").isNotNull()
    error = (
        F.when(unreadable, UNREADABLE)
        .when(~F.coalesce("j.ok", F.lit(False)), t.first_filled(F.col("j.error"), t.first_filled(F.col("j.state"), F.lit(UNSTATED))))
        .when(~F.col("has_result"), NO_RESULT)
        .when(F.col("__broken") > 0, F.concat(F.lit(BROKEN), F.col("__broken").cast("string")))
    )
    made = rows.join(held, "page_id", "left").withColumn("error", error)
    blocks = _numbered(F.flatten(F.transform("__parts", lambda p: p["found"])))
    return made.select("page_id", F.col("error").isNull().alias("ok"), "error", F.col("j.job_id").alias("job_id"), F.coalesce(F.when(F.col("error").isNull(), blocks), F.array().cast(ENTRY)).alias("blocks"))


def _read_before(pages: DataFrame, cache: DataFrame, now: float, settings: Settings) -> DataFrame:
    """Keys of the cache that pages ask for, with their blocks; an entry that is no array of blocks is none."""
    known = caches.live(cache, now, settings).join(pages.select("key"), "key", "left_semi")
    known = known.groupBy("key").agg(F.max("answer").alias("answer")).select("key", F.from_json("answer", ENTRY).alias("__known"))
    return known.filter(F.col("__known").isNotNull() & ~F.exists("__known", lambda b: b.isNull() | b["text"].isNull()))


def ingested(pages: DataFrame, jobs: DataFrame, lines: DataFrame, cache: DataFrame, now: float, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(envelopes with key and cache_hit for all pages (page_id, key), cache entries to be saved).

    Only jobs of pages that the cache (key, answer, cached_at) lacks are looked into; a page without either has an error. Good
    results are saved, errors never. Pages that are given twice have two rows, jobs that nobody asks for none.
    """
    known = _read_before(pages, cache, now, settings)
    asked = pages.select("page_id", "key").join(known, "key", "left")
    hit = F.col("__known").isNotNull()
    missed = pages.join(known, "key", "left_anti").select("page_id")
    wanted = lambda rows: rows.join(missed, "page_id", "left_semi")
    made = envelopes(wanted(jobs), wanted(lines)).withColumnRenamed("blocks", "__blocks")
    rows = asked.join(made, "page_id", "left").select(
        "page_id",
        "key",
        (hit | F.coalesce("ok", F.lit(False))).alias("ok"),
        F.when(~hit, F.coalesce("error", F.when(F.col("ok").isNull(), MISSING))).alias("error"),
        F.when(hit, F.lit("cache")).otherwise(F.col("job_id")).alias("job_id"),
        hit.alias("cache_hit"),
        F.coalesce("__known", "__blocks", F.array().cast(ENTRY)).alias("blocks"),
    )
    answer = F.to_json("blocks")
    results = rows.filter(~F.col("cache_hit")).select("key", answer.alias("answer"), answer.alias("value"), F.lit(None).cast("string").alias("normalized_value"), "error", F.lit(False).alias("timed_out"))
    return rows, caches.entries(results, now, settings)


def blocks(rows: DataFrame) -> DataFrame:
    """The blocks of envelopes, as ocr.blocks gives them."""
    one = rows.select("page_id", F.posexplode("blocks").alias("block_seq", "b"))
    side = lambda k: F.get("b.box", F.lit(k))
    middle = lambda k: F.coalesce(F.get("b.center", F.lit(k)), (side(k) + side(k + 2)) / 2.0)
    return one.select(
        "page_id", "block_seq", F.col("b.id").alias("block_id"), "b.text", F.coalesce("b.score", F.lit(0.0)).alias("score"),
        *[side(k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], middle(0).alias("cx"), middle(1).alias("cy"), "b.source",
    )


def write(rows: DataFrame, path: str) -> None:
    """Envelopes as JSON lines in two folders: `blocks` of what was read, `errors` of what was not."""
    rows.filter("ok").select("page_id", "job_id", "cache_hit", "blocks").write.mode("overwrite").json(f"{path}/blocks")
    rows.filter(~F.col("ok")).select("page_id", "job_id", "error").write.mode("overwrite").json(f"{path}/errors")
