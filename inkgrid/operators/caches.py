"""Content-addressed caches as tables: keys from content, hits and misses as joins, entries that expire, what may be saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.config import Settings


def key(*parts: Column) -> Column:
    """SHA-256 over the parts as a canonical JSON array; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])), 256)


def content_key(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def reading_key(provider: Column, model: Column, image: Column, version: str) -> Column:
    """The key of a second reading: field, rule and parameters (columns of the catalogue), provider, model, image and prompt version."""
    return key(F.col("field_id"), F.col("label"), F.col("validator"), F.to_json("params"), provider, F.coalesce(model, F.lit("")), content_key(image), F.lit(version))


def live(cache: DataFrame, now: float, settings: Settings) -> DataFrame:
    """Entries that count: good ones for ever, timeouts (cached_at set) for the time to live, none of these if it is 0; none at all if caches are off."""
    if not settings.caches:
        return cache.limit(0)
    if settings.cache_ttl_s <= 0:
        return cache.filter("cached_at is null")
    return cache.filter(F.col("cached_at").isNull() | (F.lit(now) - F.col("cached_at") <= settings.cache_ttl_s))


def hits(requests: DataFrame, cache: DataFrame, on: str = "key") -> DataFrame:
    return requests.join(cache.select(on), on, "left_semi")


def misses(requests: DataFrame, cache: DataFrame, on: str = "key") -> DataFrame:
    """Requests that have to be worked out: only these go to a connector."""
    return requests.join(cache.select(on), on, "left_anti")


def answered(requests: DataFrame, cache: DataFrame, on: str = "key") -> DataFrame:
    """Requests with the cached answer (of several the least) and cache_hit."""
    known = cache.groupBy(on).agg(F.min("answer").alias("answer"), F.lit(True).alias("__hit"))
    return requests.join(known, on, "left").withColumn("cache_hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def entries(results: DataFrame, now: float, settings: Settings) -> DataFrame:
    """What is saved of results (key, answer, value, normalized_value, error, timed_out): key, answer, cached_at.

    Timeouts are saved with their time, so that they expire; other errors and empty readings never are; nothing is if caches
    are off. A key that has a good answer is not saved as a timeout too.
    """
    filled = (F.coalesce("value", F.lit("")) != "") | (F.coalesce("normalized_value", F.lit("")) != "")
    late = F.coalesce("timed_out", F.lit(False))
    fine = ~late & (F.coalesce("error", F.lit("")) == "") & filled
    kept = results.filter(F.lit(settings.caches) & (fine | (late & F.lit(settings.cache_ttl_s > 0))))
    at = F.when(late, F.lit(float(now)))
    best = F.min(F.struct(at.isNotNull().alias("late"), F.col("answer").alias("answer"), at.alias("at"))).alias("b")
    return kept.groupBy("key").agg(best).select("key", "b.answer", F.col("b.at").alias("cached_at"))


def _bucketed(rows: DataFrame, buckets: int):
    return rows.select("key", "answer", "cached_at").repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key")


def save_table(results: DataFrame, now: float, settings: Settings, name: str, buckets: int = 64) -> None:
    """Adds what may be saved to a cache table in buckets by key, which is made at the first time; each key stays one row.

    Joins with the table by key (`hits`, `misses`, `answered`) leave it where it lies: only the other side is shuffled. What is
    there already and still counts is not saved again, so that a step that is repeated changes nothing. An expired entry stays
    until `compact`; a good answer to its key is added beside it and counts.
    """
    spark, new = results.sparkSession, entries(results, now, settings)
    if spark.catalog.tableExists(name):
        known = live(spark.table(name), now, settings).select("key", F.col("cached_at").alias("__since"))
        # A good answer may follow a timeout; nothing follows a good answer.
        held = known.groupBy("key").agg(F.bool_or(F.col("__since").isNull()).alias("__good"))
        new = new.join(held, "key", "left").filter(F.col("__good").isNull() | (~F.col("__good") & F.col("cached_at").isNull()))
        rows = spark.createDataFrame([], new.schema) if new.isEmpty() else new
        _bucketed(rows, buckets).mode("append").saveAsTable(name)
    else:
        _bucketed(new, buckets).saveAsTable(name)


def compact(spark: SparkSession, now: float, settings: Settings, name: str, buckets: int = 64) -> None:
    """Rewrites a cache table with one row for each key, good answers before timeouts, without what has expired.

    The new table is complete before it takes the old one's name.
    """
    rows = live(spark.table(name), now, settings).groupBy("key").agg(F.min(F.struct(F.col("cached_at").isNotNull().alias("late"), (-F.coalesce("cached_at", F.lit(0.0))).alias("at"), "answer", "cached_at")).alias("b"))
    _bucketed(rows.select("key", "b.answer", "b.cached_at"), buckets).mode("overwrite").saveAsTable(f"{name}_compacted")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {name}_compacted RENAME TO {name.rsplit('.', 1)[-1]}")


def save(results: DataFrame, now: float, settings: Settings, path: str) -> None:
    """Adds what may be saved to a cache table."""
    entries(results, now, settings).write.mode("append").parquet(path)
