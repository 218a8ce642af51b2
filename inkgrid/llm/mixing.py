"""Mixing sources to target weights: fixed-length blocks, multinomial draws for each output shard, permuted block numbers.

The words of a source's documents, in an order by hash, are one stretch that is packed into blocks of equal length. Each output
shard draws how many of its slots go to which source. A source's slots are numbered over all shards and walk through its blocks
by one pseudorandom permutation after the other, so that no block comes up again before all others have. Blocks are joined to
slots by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import cut, in_runs, partitions
from inkgrid.llm.words import U, mixed

#: Words of a block, slots of an output shard, and how often at most a document is taken.
BLOCK_WORDS, SHARD_SLOTS, MOST_TIMES = 256, 4096, 3
WEIGHTS = (1, 2, 3)
SEED, ROUNDS = 11, 8
#: Sources are listed on the driver: at most so many, with names of at most so many bytes together.
MOST_SOURCES, MOST_NAMES = 1 << 16, 8 << 20
#: A source's documents are added up in so many parts by hash, shards in groups of so many.
PARTS, GROUP = 1 << 10, 1 << 10
#: Shards whose slots one task makes, where there are more than tasks.
TASK_SHARDS = 64
SEPARATORS = r"\x20\x09-\x0D"
SLOTS = "shard bigint, slot bigint, source_no int, turn int, block bigint"


def sized(docs: DataFrame) -> DataFrame:
    """Adds size, the number of words of the text: of each run of other characters one sign is left, and signs are counted."""
    one = F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{SEPARATORS}]++", "x")
    return docs.withColumn("size", F.char_length(F.translate(one, " \t\n\x0b\x0c\r", "")).cast("long"))


def targets(sizes: list[int], weights: tuple = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """How many words the mix takes of each source: shares of all words by weight, none above `most` times its size.

    What a source can't give is shared among the others by weight, until none is above.
    """
    weigh = [weights[k % len(weights)] for k in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = float(sum(sizes) - most * sum(sizes[k] for k in full))
        total = sum(w for k, w in enumerate(weigh) if k not in full)
        aim = [float(most * s) if k in full else left * weigh[k] / total for k, s in enumerate(sizes)]
        above = {k for k, s in enumerate(sizes) if k not in full and aim[k] > most * s}
        if not above:
            return aim
        full |= above


class Plan:
    """What is known of the sources: names in order, sizes, targets, blocks, and how many slots of the mix each gets."""

    def __init__(self, names: list[str | None], sizes: list[int], block: int = BLOCK_WORDS, weights: tuple = WEIGHTS, most: int = MOST_TIMES):
        self.names, self.sizes, self.block = names, sizes, block
        self.targets = targets(sizes, weights, most)
        self.blocks = [-(-s // block) for s in sizes]
        # Whole turns through a source take it all; the rest of the target is as many of its blocks as come nearest.
        self.slots = []
        for size, aim, blocks in zip(sizes, self.targets, self.blocks):
            turns = min(most, int(aim // size)) if size else 0
            over = min(blocks, int((aim - turns * size) / block + 0.5)) if size and turns < most else 0
            self.slots.append(turns * blocks + over)

    @property
    def total(self) -> int:
        return sum(self.slots)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, n, s, t) for k, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets))]
        return spark.createDataFrame(rows, "source_no int, source string, source_size bigint, target double")


def plan(rows: DataFrame, block: int = BLOCK_WORDS, weights: tuple = WEIGHTS, most: int = MOST_TIMES) -> Plan:
    """The plan for (source, size); sources come in code point order, null last. More of them than can be listed are an error."""
    found = cut(rows.groupBy("source").agg(F.sum("size").alias("size")))
    n, names = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if n > MOST_SOURCES or names > MOST_NAMES:
        raise ValueError(f"{n} sources with {names} bytes of names: a mix is stated over at most {MOST_SOURCES} and {MOST_NAMES}")
    listed = sorted(((r["source"], r["size"]) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    return Plan([r[0] for r in listed], [r[1] for r in listed], block, weights, most)


def running(rows: DataFrame, group: str, part: str, order: list, value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the group before this one, by (part, order).

    Sums run within parts, and over the parts' totals, so that a group of any size is never in one task.
    """
    before = [Window.unboundedPreceding, Window.currentRow]
    totals = rows.groupBy(group, part).agg(F.sum(value).alias("__total"))
    totals = totals.withColumn("__before", F.sum("__total").over(Window.partitionBy(group).orderBy(part).rowsBetween(*before)) - F.col("__total"))
    inner = rows.withColumn("__in", F.sum(value).over(Window.partitionBy(group, part).orderBy(*order).rowsBetween(*before)) - F.col(value))
    return inner.join(totals.drop("__total"), [group, part]).withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before")


def placed(rows: DataFrame, made: Plan) -> DataFrame:
    """doc_id, size, source_no, source_size, target, text_hash and first: the place of the document's first word in its source.

    Takes (doc_id, source, size, text_hash). Equal rows are counted, placed as one and written out again.
    """
    known = F.broadcast(made.table(rows.sparkSession))
    numbered = rows.alias("r").join(known.alias("k"), F.expr("r.source <=> k.source")).select("doc_id", "size", "source_no", "source_size", "target", "text_hash")
    keys = numbered.columns
    each = numbered.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("doc_id", "text_hash", "size", F.lit(SEED)))
    each = each.withColumns({"part": F.shiftrightunsigned("h", 64 - (PARTS - 1).bit_length()).cast("int"), "words": F.col("n") * F.col("size")})
    each = running(each, "source_no", "part", ["h", "doc_id", "text_hash", "size"], "words", "begin")
    return in_runs(each.withColumn("no", F.lit(0).cast("long")), [*keys, "begin"], "no", "n", "copy").select(*keys, (F.col("begin") + F.col("copy") * F.col("size")).alias("first"))


def parts(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents' pieces in blocks: a row for each block that a document reaches into, with block, skip and words.

    skip is how many of the document's words come before; empty documents reach into none.
    """
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))
    rows = docs.filter("size > 0").withColumn("block", F.explode(blocks))
    begin = F.greatest(F.col("first"), F.col("block") * block)
    return rows.withColumns({"skip": begin - F.col("first"), "words": F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - begin})


def draws(spark: SparkSession, made: Plan, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, source_no, n): what each output shard's multinomial draw gives each source, by the sources' shares of all slots."""
    total = made.total
    shards = -(-total // shard_slots)
    chance = np.array(made.slots, float) / max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                here = min(shard_slots, total - shard * shard_slots)
                n = np.random.Generator(np.random.PCG64([seed, shard])).multinomial(here, chance)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(n[some])], ["shard", "source_no", "n"])

    return spark.range(shards).mapInArrow(run, "shard bigint, source_no int, n bigint")


def permuted(number: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 .. size-1 that hangs on the key puts each number: a Feistel network on a near-square, walked until inside."""
    a = np.array([isqrt(max(int(s) - 1, 0)) + 1 for s in size.tolist()], np.int64) if len(set(size.tolist())) > 1 else np.full(len(size), isqrt(max(int(size[0]) - 1, 0)) + 1 if len(size) else 1)
    b = -(-np.maximum(size, 1) // a)
    out, left = number.copy(), np.arange(len(number))
    while len(left):
        l, r = out[left] // b[left], out[left] % b[left]
        with np.errstate(over="ignore"):
            for i in range(ROUNDS):
                salt = key[left] + U(i) * U(0x9E3779B97F4A7C15)
                if i % 2:
                    r = (r + (mixed(mixed(salt) + l.astype(U)) % b[left].astype(U)).astype(np.int64)) % b[left]
                else:
                    l = (l + (mixed(mixed(salt) + r.astype(U)) % a[left].astype(U)).astype(np.int64)) % a[left]
        out[left] = l * b[left] + r
        left = left[out[left] >= size[left]]
    return out


def slots(spark: SparkSession, made: Plan, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, slot, source_no, turn, block of every slot of the mix.

    A source's i-th slot over all shards is turn i div blocks and the (i mod blocks)-th block of that turn's permutation. A
    multinomial draw misses the planned number of a source's slots by a little: what a source drew beyond its number goes to
    the sources that drew short, in order, so that every source has as many slots as planned.
    """
    drawn = cut(draws(spark, made, shard_slots, seed).withColumn("group", F.expr(f"cast(shard div {GROUP} as int)")))
    got = np.zeros(len(made.slots), np.int64)
    for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        got[r["source_no"]] = r["n"]
    want, blocks = np.array(made.slots, np.int64), np.array(made.blocks, np.int64)
    spare = np.r_[0, np.cumsum(np.maximum(got - want, 0))]
    short = np.r_[0, np.cumsum(np.maximum(want - got, 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, source, n, start, slot = (batch.column(k)[row].as_py() for k in range(5))
                i = start + np.arange(n)
                of = np.full(n, source)
                over = np.flatnonzero(i >= want[source])
                freed = spare[source] + i[over] - want[source]
                to = np.searchsorted(short, freed, "right") - 1
                of[over], i[over] = to, got[to] + freed - short[to]
                turn, key = i // blocks[of], mixed(U(seed) + of.astype(U) * U(1 << 20))
                with np.errstate(over="ignore"):
                    block = permuted(i % blocks[of], blocks[of], mixed(key + turn.astype(U)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(slot + np.arange(n)), pa.array(of.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(block)], ["shard", "slot", "source_no", "turn", "block"])

    # Rows grow to SHARD_SLOTS slots for each shard: what a task makes is bounded by shards, not by the bytes it reads.
    shards = -(-made.total // shard_slots)
    tasks = max(1, min(shards, max(partitions(spark), shards // TASK_SHARDS)))
    begun = running(drawn, "source_no", "group", ["shard"], "n", "start").repartition(tasks, "shard")
    in_shard = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = begun.withColumn("slot", F.sum("n").over(in_shard) - F.col("n"))
    return begun.select("shard", "source_no", "n", "start", "slot").mapInArrow(run, SLOTS)


def _rows(docs: DataFrame) -> DataFrame:
    return sized(docs.select("doc_id", "source", "text")).withColumn("text_hash", F.xxhash64("text"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of it in the mix, repeats counted) of every row of (doc_id, source, text).

    Sources weigh `weights` in turn. A source's taken words miss its target by less than two blocks; no word is taken more than
    `most` times. Null and empty texts have size 0 and give nothing; a null source is a source; rows that repeat lie side by
    side in their source and are taken one by one; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(_rows(docs).drop("text"))
    made = plan(rows, block, weights, most)
    held = cut(placed(rows, made))
    uses = slots(docs.sparkSession, made, shard_slots, seed).groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    # By hint, since the optimizer takes rows that few shards draw for few rows and would broadcast them.
    taken = parts(held, block).join(uses.hint("merge"), ["source_no", "block"]).groupBy("source_no", "first").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    full = held.filter("size > 0").join(taken, ["source_no", "first"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    shown = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(*shown).unionByName(held.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*shown))


def mixed_parts(docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot, source, turn, block, place (where in the block), doc_id and text of every part of a slot's block.

    text has the part's words joined by one blank; a slot's block is its parts in order of place. Texts that repeat under one
    doc_id and source are read once.
    """
    rows = cut(_rows(docs).drop("text"))
    made = plan(rows, block, weights, most)
    pieces = parts(placed(rows, made), block).withColumn("place", F.greatest(F.col("first") - F.col("block") * block, F.lit(0)))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), f"[{SEPARATORS}]+"), lambda w: w != "")
    texts = docs.select("doc_id", "source", "text").distinct().withColumn("text_hash", F.xxhash64("text"))
    names = F.broadcast(made.table(docs.sparkSession).select("source_no", "source"))
    texts = texts.alias("t").join(names.alias("k"), F.expr("t.source <=> k.source")).select(F.col("doc_id").alias("id"), F.col("source_no").alias("of"), "text", F.col("text_hash").alias("hash"))
    found = pieces.join(texts, F.expr("doc_id <=> id and source_no = of and text_hash = hash"))
    found = found.withColumn("text", F.array_join(F.slice(words, F.col("skip").cast("int") + 1, F.col("words").cast("int")), " "))
    mixed_in = slots(docs.sparkSession, made, shard_slots, seed).hint("merge").join(found.select("source_no", "block", "place", "doc_id", "text"), ["source_no", "block"])
    return mixed_in.join(names, "source_no").select("shard", "slot", "source", "turn", "block", "place", "doc_id", "text")
