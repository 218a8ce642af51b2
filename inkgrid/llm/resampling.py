"""Importance resampling towards a target distribution of hashed n-grams.

The corpus becomes a sparse document-by-bucket count matrix, kept as blocks of compressed rows (CSR) in Parquet. Its column sums
are the raw distribution, those of the target texts' matrix the target's; a bucket's gain is the scaled logarithm of their
quotient, and the matrix times the vector of gains is a weight for each document. Noise by a hash of the id (Gumbel's top-k)
makes the highest scores a draw without replacement. Text is read once; what follows reads the matrix.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.llm.common import bucket_of, in_runs, partitions, range_splits, remove_folder, shared_dir
from inkgrid.llm.words import BLOCK, blocks, plain_table, slices, text_bytes

BUCKETS, ORDER = 10_000, 3
#: Documents of fewer words are weighed but never drawn; of the others this many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Words of so many bytes and more go through zlib one by one.
LONG = 64
#: Parquet row groups of the matrix, in bytes: what a reader decodes at once.
ROW_GROUP = 8 << 20
#: Rows that one range of the ranking aims at, and most ranges.
RANGE_ROWS, MOST_RANGES = 1 << 20, 4096


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 by bytes, and for every n < LONG what n zero bytes make of a checksum's four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    made = [now]
    for _ in range(LONG - 1):
        now = step[now & 255] ^ (now >> 8)
        made.append(now)
    return step, np.concatenate([m.ravel() for m in made])


STEP, SHIFT = _shift_tables()
_BLANK = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The checksums after n more zero bytes each, without the conditioning: crc(a + b) is shifted(crc(a), len(b)) ^ crc(b)."""
    at = np.asarray(n, np.int64) * 1024
    return SHIFT[at + (crc & 255)] ^ SHIFT[at + 256 + ((crc >> 8) & 255)] ^ SHIFT[at + 512 + ((crc >> 16) & 255)] ^ SHIFT[at + 768 + (crc >> 24)]


def _word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the words data[start : start + size]."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(size < LONG)
    for j in range(LONG):
        left = left[size[left] > j]
        if not len(left):
            break
        now = crc[left]
        crc[left] = STEP[(now ^ data[start[left] + j]) & 255] ^ (now >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size >= LONG):
        crc[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes())
    return crc


def counted(column: pa.Array, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row * buckets + bucket in order, how often, words of each row) of all runs of 1 to `order` words in the texts.

    A text is read in blocks; the checksums of the runs that end with a block's last word are carried into the next, so a
    text of any length needs no more than a block and its own buckets.
    """
    data, offsets = text_bytes(column)
    words = np.zeros(len(column), np.int64)
    held, last_row = [], -1
    last = np.zeros(order, np.uint32)  # of the runs of 1, 2, .. words that end with the last word
    runs = 0
    for block, starts, first in blocks(data, offsets, plain_table()):
        inside = block != 0
        before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        before[starts[starts < len(block)]] = False
        after[starts[(starts > 0) & (starts < len(block))] - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if not len(s):
            continue
        size, row = e - s, np.searchsorted(offsets, s + first, "right") - 1
        words += np.bincount(row, minlength=len(column))
        same = np.r_[last_row, row[:-1]] == row
        crc = [_word_crcs(block, s, size)]
        there = [np.ones(len(s), bool)]
        small = size < LONG
        for k in range(1, order):
            lead = shifted(np.r_[last[k - 1], crc[-1][:-1]], 1) ^ _BLANK
            there.append(same & np.r_[runs >= k, there[-1][:-1]])
            made = shifted(lead, np.where(small, size, 0)) ^ crc[0]
            for i in np.flatnonzero(~small & there[-1]):
                made[i] = zlib.crc32(block[s[i] : e[i]].tobytes(), int(lead[i]))
            crc.append(made)
        keys = np.concatenate([row[t] * buckets + c[t] % np.uint32(buckets) for c, t in zip(crc, there)])
        held.append(np.unique(keys, return_counts=True))
        if len(held) > 64:
            held = [_merged(held)]
        last, last_row = np.array([c[-1] for c in crc], np.uint32), row[-1]
        runs = int(sum(t[-1] for t in there))
    keys, counts = _merged(held)
    return keys, counts, words


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts' counts added up, in order of the keys."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[head], np.add.reduceat(counts, head)


def matrix(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """CSR blocks of the count matrix of (doc_id, text), a row of the matrix for each text and about 256 KB of text a block.

    ids and words (how many words) have an entry for each row; row i's cells are indptr[i] to indptr[i + 1] of `gaps` (each
    column less the one before it in the row) and `counts`: little-endian int32, uint16 (uint32 beyond 65536 buckets) and
    uint32. Null and empty texts are rows without cells.
    """
    wide = "<u2" if buckets <= 1 << 16 else "<u4"
    kind = texts.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("words", T.ArrayType(T.LongType())), *[T.StructField(n, T.BinaryType()) for n in ("indptr", "gaps", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BLOCK):
            keys, counts, words = counted(batch.column(1), buckets, order)
            columns = keys % buckets
            bounds = np.searchsorted(keys, np.arange(batch.num_rows + 1) * buckets)
            gaps = np.diff(columns, prepend=0)
            heads = bounds[:-1][bounds[:-1] < bounds[1:]]
            gaps[heads] = columns[heads]
            one = lambda v, t: pa.array([v.astype(t).tobytes()], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([words.tolist()], pa.list_(pa.int64())), one(bounds, "<i4"), one(gaps, wide), one(counts, "<u4")], ["ids", "words", "indptr", "gaps", "counts"]
            )

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def _cells(indptr: bytes, gaps: bytes, counts: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, columns, counts) of a block."""
    bounds, counts = np.frombuffer(indptr, "<i4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
    summed = np.r_[0, np.cumsum(np.frombuffer(gaps, "<u2" if buckets <= 1 << 16 else "<u4").astype(np.int64))]
    return bounds, summed[1:] - np.repeat(summed[bounds[:-1]], np.diff(bounds)), counts


def column_sums(blocks_: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is in the whole matrix; no more than `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(3))):
                _, columns, counts = _cells(*(v.as_py() for v in row), buckets)
                # In doubles, which are exact: a block is far from 2^53 words.
                total += np.bincount(columns, weights=counts, minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for r in blocks_.select("indptr", "gaps", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the quotient of a bucket's two shares), each with one added to every bucket; in doubles."""
    t, s, buckets = int(target.sum()), int(raw.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((x + 1.0) * (s + float(buckets)) / ((y + 1.0) * (t + float(buckets))))) for x, y in zip(target.tolist(), raw.tolist())], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """A standard Gumbel number by the hash of the id (null: as of an empty one), in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks_: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (the matrix row times the gains) and score (plus noise) of every row of the matrix."""
    buckets = len(gain)
    schema = T.StructType([T.StructField("doc_id", blocks_.schema["ids"].dataType.elementType), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words = batch.column(0)[k].values, batch.column(1)[k].values
                bounds, columns, counts = _cells(*(batch.column(j)[k].as_py() for j in (2, 3, 4)), buckets)
                rows = lambda v: np.diff(np.r_[0, np.cumsum(v)][bounds])
                weight = rows(gain[columns] * counts)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(rows(counts)), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks_.mapInArrow(run, schema)


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank, 1, 2, .. by score, ties to the smaller doc_id (null last), of the share drawn; null for the others.

    Scores are dealt into ranges; only ranges that reach into the share are sorted. Equal rows are counted before, so that
    none of them, however many, lie in one task; which of them gets which rank does not matter.
    """
    spark = scored.sparkSession
    may = F.col("n_words") >= least_words
    total = scored.filter(may).count()
    most = percent * total // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not most:
        return none
    low = scored.withColumn("__low", -F.col("score"))
    splits = range_splits(low.filter(may), "__low", min(MOST_RANGES, max(partitions(spark), total // RANGE_ROWS)))
    low = low.withColumn("__range", bucket_of(F.col("__low"), splits))
    sizes = {r["__range"]: r["count"] for r in low.filter(may).groupBy("__range").count().collect()}
    before = [sum(sizes.get(k, 0) for k in range(p)) for p in range(len(splits) + 1)]
    reach = F.lit(sum(b < most for b in before))
    named = [c for c in scored.columns]
    each = low.filter(may & (F.col("__range") < reach)).groupBy("__range", "__low", *named).agg(F.count("*").alias("__n"))
    order = Window.partitionBy("__range").orderBy("__low", F.asc_nulls_last("doc_id"), *[c for c in named if c not in ("doc_id", "score")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__range"))
    each = each.withColumn("__start", F.sum("__n").over(order) - F.col("__n") + first)
    top = in_runs(each, named, "__start", "__n", "rank").withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1))
    rest = low.filter(~may | (F.col("__range") >= reach)).select(*named, F.lit(None).cast("long").alias("rank"))
    return top.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, keep: str | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of `docs` (doc_id, text) drawn towards `target` (text).

    The matrix is written to the shared folder, or to `keep`, where it stays for other targets; without `keep` it goes when
    all rows are weighed, and only the weights remain. Null and empty texts have no features, weight 0 and are never drawn;
    rows that repeat are drawn one by one; an id that is null hashes as an empty one; other columns are ignored. An empty
    corpus gives no rows; an empty target has equal shares in all buckets.
    """
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/resampling-{uuid4().hex}"
    path = keep or f"{base}/matrix"
    matrix(docs, buckets, order).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(path)
    held = spark.read.schema(matrix(docs, buckets, order).schema).parquet(path)
    wanted = column_sums(matrix(target.select(F.lit(0).alias("doc_id"), "text"), buckets, order), buckets)
    weights(held, gains(wanted, column_sums(held, buckets)), seed).write.parquet(f"{base}/scored")
    if not keep:
        remove_folder(spark, path)
    return ranked(spark.read.parquet(f"{base}/scored"), percent, least_words)


def drawn_docs(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all their columns, whose doc_id was drawn; for tables in which no doc_id repeats or is null."""
    return docs.join(resample(docs, target, **how).filter("rank is not null").select("doc_id"), "doc_id", "left_semi")
