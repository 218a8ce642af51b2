"""The driver's tables as inputs: forms, tasks, logs, cache requests and recogniser output derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions.once import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def form_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of forms, one form for each user: an event's number gives place, size, score and kind of text."""
    e = F.col("event_id")
    kinds = {
        0: (e % 30).cast("string"),
        1: F.lit("N/A"),
        2: F.lit("重庆"),
        3: F.concat(F.lit("AMM"), e.cast("string")),
        4: F.concat(F.lit("CAACML"), F.lpad(e.cast("string"), 8, "0")),
        5: F.date_format("ts", "yyyy.MM.dd"),
        6: F.col("event_type"),
        7: F.lit("replaced oil pump 更换油泵并试车"),
        8: F.when(e % 3 == 0, "checked").otherwise("勾选"),
        9: F.lit(""),
        10: F.concat(F.lit("pump seal leaking at station "), e.cast("string")),
        11: F.lit("更换前轮胎并完成测试"),
        12: F.when(e % 3 == 0, "SIGN DATE").otherwise("报告者"),
        13: F.lit("2024.01.02"),
        14: F.when(e % 3 == 0, "李冬").otherwise("A. Meyer"),
    }
    text = F.lpad(e.cast("string"), 6, "0")
    for k, made in reversed(kinds.items()):
        text = F.when(e % 16 == k, made).otherwise(text)
    x1, y1 = (e * 37) % 2200, (e * 53) % 1600
    box = {"x1": x1, "y1": y1, "x2": x1 + 20 + e % 90, "y2": y1 + 18 + e % 40}
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "event_id").select(
        F.col("user_id").alias("page_id"),
        e.alias("block_seq"),
        F.concat(F.lit("b"), e.cast("string")).alias("block_id"),
        text.alias("text"),
        ((e % 1024).cast("double") / F.lit(1024.0)).alias("score"),
        *[c.cast("double").alias(n) for n, c in box.items()],
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of tasks, one task for each order: all are created, most are claimed, some end."""
    o = table(spark, sf_dir, "orders")
    at = F.unix_timestamp("o_orderdate").cast("double")
    base = o.select(
        F.col("o_orderkey").cast("string").alias("task_id"),
        F.col("o_orderpriority").alias("session_id"),
        F.concat(F.lit("scan-"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("filename"),
        at.alias("created"),
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("s"),
    )
    step = lambda kind, delay, cond, error="null", progress="null", report="null": base.filter(cond).select(
        "task_id", "session_id", F.lit(kind).alias("kind"), (F.col("created") + delay).alias("at"), "filename",
        F.expr(progress).cast("string").alias("progress"), F.expr(error).cast("string").alias("error"), F.expr(report).cast("string").alias("report_path"),
        F.col("task_id").alias("run_id"), F.concat(F.lit("/up/"), F.col("task_id"), F.lit("/upload.png")).alias("upload_path"), F.lit(None).cast("string").alias("request_id"),
    )
    steps = (
        ("created", 0.0, "true"),
        ("claimed", 60.0, "k % 5 <> 0"),
        ("progress", 90.0, "k % 7 = 1 and k % 5 <> 0", "null", "'{\"stage\": \"reading\"}'"),
        ("done", 300.0, "s = 'F' and k % 5 <> 0", "null", "null", "concat('/up/', task_id, '/report.json')"),
        ("failed", 400.0, "s = 'P' and k % 5 <> 0", "'un\"readable'"),
    )
    out = step(*steps[0])
    for s in steps[1:]:
        out = out.unionByName(step(*s))
    return out


def recogniser_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form blocks nested as recogniser output, a record for each form; every eleventh text is empty."""
    b = form_blocks(spark, sf_dir)
    b = b.withColumn("text", F.when(F.col("block_seq") % 11 == 0, "").otherwise(F.col("text")))
    entry = F.struct("block_seq", "text", "score", F.array("x1", "y1", "x2", "y2").alias("box"))
    rows = b.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    part = lambda c: F.transform("e", lambda x: x[c])
    pruned = F.struct(part("text").alias("rec_texts"), part("score").alias("rec_scores"), part("box").alias("rec_boxes"))
    ocr = F.struct(pruned.alias("prunedResult"), F.lit(None).cast("string").alias("ocrImage"))
    return rows.select("page_id", F.lit(1).alias("record_no"), F.struct(F.array(ocr).alias("ocrResults")).alias("result"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, one for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("line_no"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.col("event_type").alias("event"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task_id"), (F.col("event_id") % 3).cast("string").alias("run_id"), F.col("props").alias("payload"),
    )
