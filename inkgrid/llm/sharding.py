"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered 0 .. N-1 by (hash of the row, doc_id, checksum, size), permuted without a table, and dealt
round robin, so that anybody who knows N, the seed and a row's number can compute its shard and slot.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fewest and most leading bits of a row's hash that name its bucket in the numbering, and how many rows a bucket aims at.
BITS, MOST_BITS = 10, 14
BUCKET_ROWS = 1 << 20
#: Rows that repeat are written out in runs of at most so many, so that a hot row is spread over tasks.
RUN = 1 << 14
ROUNDS = 8


def sides(rows: int) -> tuple[int, int]:
    """The smallest near-square a x b with a*b >= rows; fewer than a cells are left over."""
    a = max(1, isqrt(max(rows - 1, 0)) + 1)
    return a, -(-max(rows, 1) // a)


def feistel(number: str, a: int, b: int, seed: int) -> Column:
    """One pass of a permutation of 0 .. a*b-1 over the column `number`.

    The number is a cell of an a x b rectangle; in turn each coordinate moves by a hash of the other.
    """
    start = F.expr(f"named_struct('l', {number} div {b}, 'r', {number} % {b})")

    def turn(s: Column, i: Column) -> Column:
        by = lambda other, side: F.pmod(F.xxhash64(other, i, F.lit(seed)), F.lit(side))
        moved_l = F.pmod(s["l"] + by(s["r"], a), F.lit(a)).cast("long")
        moved_r = F.pmod(s["r"] + by(s["l"], b), F.lit(b)).cast("long")
        return F.when(i % 2 == 0, F.struct(moved_l.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved_r.alias("r")))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return end["l"] * F.lit(b) + end["r"]


def walk_length(spark: SparkSession, rows: int, seed: int) -> int:
    """The most steps that a cycle walk takes outside 0 .. rows-1 before it is back.

    Only the fewer than sqrt(rows)+1 cells from `rows` on are outside; they are walked until no more come back.
    Those that never do lie on cycles of their own, which no row enters.
    """
    a, b = sides(rows)
    at, steps, left = spark.range(rows, a * b).select(F.col("id").alias("x")), 0, a * b - rows
    while left:
        at = at.select(feistel("x", a, b, seed).alias("x")).filter(F.col("x") >= rows)
        still = at.count()
        if still == left:
            break
        steps, left = steps + 1, still
    return steps


def permuted(df: DataFrame, number: str, rows: int, seed: int, out: str) -> DataFrame:
    """Adds `out`, the place of row `number` in the shuffle of 0 .. rows-1 (cycle walking inside the rectangle)."""
    a, b = sides(rows)
    df = df.withColumn(out, feistel(number, a, b, seed))
    for _ in range(walk_length(df.sparkSession, rows, seed)):
        df = df.withColumn(out, F.when(F.col(out) < rows, F.col(out)).otherwise(feistel(out, a, b, seed)))
    return df


def numbered_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Adds row_no, 0 .. N-1 in the order of (hash of the keys, keys), and says N. `rows` has the keys and no more.

    Equal rows are counted before the shuffle, numbered as one and written out in runs: however often a row repeats, no
    task gets all its copies. Buckets grow in number with the rows; the numbers do not hang on how many there are.
    """
    fine = F.shiftrightunsigned("h", 64 - MOST_BITS).cast("int")
    rows = rows.withColumn("h", F.xxhash64(*keys)).withColumn("fine", fine)
    counts = {r["fine"]: r["n"] for r in rows.groupBy("fine").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    bits = min(MOST_BITS, max(BITS, (total // BUCKET_ROWS).bit_length()))
    before, seen = [], 0
    for k in range(1 << MOST_BITS):
        if k % (1 << (MOST_BITS - bits)) == 0:
            before.append(seen)
        seen += counts.get(k, 0)
    distinct = rows.groupBy("h", *keys).agg(F.count("*").alias("n")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    in_bucket = Window.partitionBy("bucket").orderBy(F.shiftleft("h", bits), *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("bucket"))
    distinct = distinct.withColumn("start", F.sum("n").over(in_bucket) - F.col("n") + first)
    runs = distinct.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})"))).repartition("h", "run")
    numbers = F.sequence(F.col("start") + F.col("run") * RUN, F.col("start") + F.least(F.col("run") * RUN + RUN, F.col("n")) - 1)
    return runs.select(*keys, F.explode(numbers).alias("row_no")), total


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Deals all rows of `docs` (doc_id, text) into shards under the law `rows`: counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, law, shard, slot (0, 1, ...
    without a gap in each shard), grown_shard (null: this law moves rows when a shard is added) and row_no, shuffled:
    the number before and after the permutation. Rows that repeat get numbers of their own; which of several equal
    rows gets which does not matter. An empty table gives no rows; null doc_ids and texts are ordinary values; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered_rows(rows, ["doc_id", "text_crc32", "size"])
    return permuted(rows, "row_no", total, seed, "shuffled").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("shuffled", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"shuffled div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
        "shuffled",
    )
