"""What several operators share: reading tables, range buckets and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and for what lies between stages, as the session's spark.checkpoint.dir names it.

    Without that setting there is no folder that all executors share, and none is made up: the call fails.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with at least this many rows, and this share of all, is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_LEAST, HOT_SHARE = 1000, 1 / 500


def hot_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of `rows` with `table`, which has each key once and in `size` how many of the `total` rows have it.

    The table's rows of hot keys, 1 / HOT_SHARE at most, are broadcast, so that no task gets all rows of a hot key; the
    other keys are shuffled as usual. `size` is dropped.
    """
    hot = F.col(size) >= max(HOT_LEAST, int(total * HOT_SHARE))
    few = F.broadcast(table.filter(hot).drop(size))
    rest = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti").join(table.filter(~hot).drop(size), key)
    return rest.unionByName(rows.join(few, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_splits(df: DataFrame, column: str, pieces: int) -> list:
    """At most pieces - 1 ascending split points that deal the column's values about evenly."""
    if pieces < 2:
        return []
    wanted = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(column, wanted, 20 * pieces).alias("s")).first()["s"]
    return sorted(set(found or []))


def bucket_of(value: Column, splits: list) -> Column:
    """How many split points are at most the value: a binary search in one literal array (null: 0)."""
    if not splits:
        return F.lit(0)
    points = F.array(*[F.lit(s) for s in splits])
    step = 1 << (len(splits).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(points, at + s - 1) <= value, at + s).otherwise(at),
    )


def plain_ids(docs: DataFrame) -> bool:
    """Whether doc_id is different in every row and never null."""
    return not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()


def numbered(docs: DataFrame, out: str = "gid", plain: bool | None = None) -> DataFrame:
    """Adds a long that is different in every row and never null, ordered as (doc_id, nulls first; text).

    Where doc_id is that already, which one pass over the ids tells if the caller does not know, it is taken as it is. Else rows are numbered: within
    ranges of doc_id, plus the rows of the ranges before.
    """
    spark = docs.sparkSession
    if plain_ids(docs) if plain is None else plain:
        return docs.filter("doc_id is not null").withColumn(out, F.col("doc_id"))
    splits = range_splits(docs, "doc_id", partitions(spark))
    rows = docs.withColumn("__piece", bucket_of(F.col("doc_id"), splits))
    sizes = {r["__piece"]: r["count"] for r in rows.groupBy("__piece").count().collect()}
    before = [sum(sizes.get(k, 0) for k in range(p)) for p in range(len(splits) + 1)]
    at = Window.partitionBy("__piece").orderBy(F.asc_nulls_first("doc_id"), "text")
    first = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("__piece"))
    return rows.withColumn(out, F.row_number().over(at) - 1 + first).drop("__piece").filter(F.col(out).isNotNull())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote to the shared folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows that repeat are written out in runs of at most so many, so that a hot row is spread over tasks.
RUN = 1 << 14


def in_runs(rows: DataFrame, keep: list[str], start: str, n: str, out: str) -> DataFrame:
    """Every row `n` times with `out` running from `start` on: rows that were counted, written out again, a run to a task."""
    runs = rows.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN)))).repartition(start, "__run")
    numbers = F.sequence(F.col(start) + F.col("__run") * RUN, F.col(start) + F.least(F.col("__run") * RUN + RUN, F.col(n)) - 1)
    return runs.select(*keep, F.explode(numbers).alias(out))
