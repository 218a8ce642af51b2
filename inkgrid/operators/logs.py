"""Structured logs: reading, tails with filters, redaction, writing, and events without repetition."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of key names whose values are never shown, and the keys that every line may have.
SENSITIVE = ("api_key", "authorization", "token", "password", "secret", "bearer")
REDACTED = "[redacted]"
KNOWN = ("ts", "level", "event", "message", "request_id", "task_id", "run_id", "session_id")


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log lines: line_no (orderable), the columns KNOWN, and `payload`, a map of all other keys; lines that are no JSON object go.

    line_no follows the files by time of change, then the lines of each, so that rotated files come before the newest one.
    """
    line = F.struct(
        F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    rows = spark.read.text(path).select(line.alias("line_no"), F.from_json(F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")), "map<string,string>").alias("m"))
    rest = F.map_filter("m", lambda k, v: ~k.isin(*KNOWN))
    return rows.filter("m is not null").select("line_no", *[F.col("m")[k].alias(k) for k in KNOWN], rest.alias("payload"))


def tail(logs: DataFrame, limit: int = 200, **ids: str | None) -> DataFrame:
    """The last lines, oldest first, of those that have all ids given; 1 to 1000 lines."""
    for name, value in ids.items():
        if value:
            logs = logs.filter(F.col(name) == value)
    return logs.orderBy(F.desc("line_no")).limit(max(1, min(limit, 1000))).orderBy("line_no")


def _files(spark: SparkSession, path: str) -> Iterator[str]:
    """The log's files, the newest day's first and of a day the last changed; days are looked into one at a time."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(system.listStatus(root))
    shown = lambda f: not f.getPath().getName().startswith(("_", "."))
    for day in sorted((f for f in found if f.isDirectory() and shown(f)), key=lambda f: f.getPath().getName(), reverse=True):
        inside = [f for f in system.listStatus(day.getPath()) if f.isFile() and shown(f)]
        yield from (f.getPath().toString() for f in sorted(inside, key=lambda f: (f.getModificationTime(), f.getPath().toString()), reverse=True))
    plain = [f for f in found if f.isFile() and shown(f)]
    yield from (f.getPath().toString() for f in sorted(plain, key=lambda f: (f.getModificationTime(), f.getPath().toString()), reverse=True))


def tail_of(spark: SparkSession, path: str, limit: int = 200, **ids: str | None) -> DataFrame:
    """The last lines of a log that `write` lays out by day, as `tail` gives them, without reading all of it.

    Files are read from the newest on, twice as many each time, and no more once they hold enough lines with the ids given.
    Days come in the order of their names, a day's files in that of their last change. A log without files gives no rows.
    """
    limit, files, read_, steps = max(1, min(limit, 1000)), _files(spark, path), [], 1
    made, held = None, 0
    while held < limit and (more := list(islice(files, steps))):
        # Numbered by how near the end its files are: the line numbers of single reads don't know of each other.
        lines_ = read(spark, more).withColumn("line_no", F.struct(F.lit(-len(read_)).alias("step"), F.col("line_no").alias("line")))
        lines_ = tail(lines_, limit, **ids)
        held += lines_.count()
        made = lines_ if made is None else made.unionByName(lines_)
        read_ += more
        steps *= 2
    if made is None:
        return tail(read(spark, path), limit, **ids)
    return tail(made, limit)


def cleaned(payload: Column) -> Column:
    """A string map without nulls and empty texts."""
    return F.map_filter(payload, lambda k, v: v.isNotNull() & (v != ""))


def redacted_map(payload: Column) -> Column:
    """A string map with the values of sensitive keys hidden."""
    return F.transform_values(payload, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), REDACTED).otherwise(v))


def _hide(value):
    if isinstance(value, dict):
        return {k: REDACTED if any(s in k.lower() for s in SENSITIVE) else _hide(v) for k, v in value.items()}
    return [_hide(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def redacted_json(values: pd.Series) -> pd.Series:
    """JSON text of any depth with the values of sensitive keys hidden; what is no JSON stays."""

    def one(text):
        try:
            return json.dumps(_hide(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return text

    return values.map(one, na_action="ignore")


def lines(logs: DataFrame) -> DataFrame:
    """Log rows (columns of KNOWN, payload) as JSON lines: `day` and `value`. Sensitive values are hidden, empty ones go, the payload wins."""
    known = F.create_map(*[c for k in KNOWN for c in (F.lit(k), F.col(k).cast("string") if k in logs.columns else F.lit(None).cast("string"))])
    payload = F.coalesce(redacted_map("payload"), F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(payload, k)), payload)
    return logs.select(F.substring("ts", 1, 10).alias("day"), F.to_json(cleaned(whole)).alias("value"))


def write(logs: DataFrame, path: str) -> None:
    """Adds log rows to a folder of JSON lines, by day."""
    lines(logs).write.partitionBy("day").mode("append").text(path)


def without_repeats(events: DataFrame, by: str, order: str, payload: str) -> DataFrame:
    """Events of each stream whose payload differs from the one before (null-safe); the first stays. streaming.queue has it for streams."""
    before = Window.partitionBy(by).orderBy(order)
    rows = events.withColumns({"__before": F.lag(payload).over(before), "__n": F.row_number().over(before)})
    return rows.filter((F.col("__n") == 1) | ~F.col("__before").eqNullSafe(F.col(payload))).drop("__before", "__n")
