"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel edit distance.

An item that occurs in a text with at most k edits leaves at least one of its k+1 pieces untouched. The pieces of all items
of a small benchmark are searched at once (Aho-Corasick) in one pass over the texts. Those of a large one are joined: pieces
have few lengths, so the texts' substrings of these lengths are hashed, sieved, and matched with the pieces by a shuffle.
Either way the item's distance is computed around each hit, and both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import cut, hot_join, numbered
from inkgrid.llm.words import U, mixed, slices, splitmix

#: Edits allowed, as a share of an item's length.
EDITS = 0.05
#: A benchmark of at most so many characters is broadcast.
BLOCK_CHARS = 4_000_000
#: Bits of the sieve that a large benchmark's pieces are put in, and code points of a text that are hashed at once.
SIEVE_BITS, STRETCH = 28, 1 << 18
HIT_SCHEMA = "doc_id bigint, item_id bigint, first_char int, last_char int, distance int"


def budget(length: int) -> int:
    return int(length * EDITS)


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """The item in budget+1 pieces of about equal length, with their places."""
    n = budget(len(text)) + 1
    for k in range(n):
        a, b = len(text) * k // n, len(text) * (k + 1) // n
        yield text[a:b], a


def _scan(masks: dict[str, int], m: int, text: str, anchored: bool, most: int) -> tuple[int, int]:
    """(least distance, first end that has it) of the pattern against stretches of text; anchored: that start at 0."""
    ones = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score = ones, 0, m
    best, at = (m, 0) if anchored else (most + 1, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (ones & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | (1 if anchored else 0)) & ones
        mh = (mh << 1) & ones
        up = mh | (ones & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(text):
        masks[c] |= 1 << k
    return dict(masks)


class Item:
    """A text to be found within its budget."""

    def __init__(self, text: str):
        self.size, self.most = len(text), budget(len(text))
        self.masks, self.back = _masks(text), _masks(text[::-1])

    def closest(self, spans: list[tuple[int, str]]) -> tuple[int, int, int] | None:
        """(distance, first, last character) of the closest occurrence in stretches (place, text) in order; the first of equals."""
        best = None
        for at, text in spans:
            d, end = _scan(self.masks, self.size, text, False, self.most)
            if d <= self.most and (best is None or d < best[0]):
                best = (d, at, end, text)
        if best is None:
            return None
        d, at, end, text = best
        _, size = _scan(self.back, self.size, text[max(0, end - self.size - self.most) : end][::-1], True, self.most)
        return d, at + end - size, at + end - 1


def stretches(starts: list[int], size: int, most: int, length: int) -> list[tuple[int, int]]:
    """What of a text of some length is looked at when an item may start at these places: joined where they overlap."""
    out: list[tuple[int, int]] = []
    for s in sorted(set(starts)):
        a, b = max(0, s - most), min(length, s + size + most)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Finder:
    """Searches texts for some items at once."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, Item(t)) for i, t in items]
        where = defaultdict(list)
        for k, (_, t) in enumerate(items):
            for piece, at in pieces(t):
                where[piece].append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.machine.add_word(piece, (len(piece), hits))
        if where:
            self.machine.make_automaton()
        self.any = bool(where)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, first, last character, distance) of the closest occurrence of each item within its budget."""
        if not self.any or not text:
            return []
        near: dict[int, list[int]] = defaultdict(list)
        for end, (size, hits) in self.machine.iter(text):
            for k, at in hits:
                near[k].append(end + 1 - size - at)
        out = []
        for k, starts in near.items():
            number, item = self.items[k]
            if found := item.closest([(a, text[a:b]) for a, b in stretches(starts, item.size, item.most, len(text))]):
                d, first, last = found
                out.append((number, first, last, d))
        return sorted(out)


def _is_small(items: DataFrame, limit: int) -> bool:
    return (items.agg(F.sum(F.char_length("text"))).first()[0] or 0) <= limit


def _held(items: DataFrame):
    """The items of a small benchmark, broadcast; null and empty texts are left out."""
    rows = items.select("item_id", "text").filter("text <> ''").orderBy("item_id", "text").collect()  # BLOCK_CHARS characters at most
    return items.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)


def piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of `size` code points."""
    n = len(codes) - size + 1
    turn = splitmix(size, 91) | U(1)
    with np.errstate(over="ignore"):
        total = np.full(n, U(size))
        spread = mixed(codes)
        for k in range(size):
            total += spread[k : k + n] * turn[k]
    return mixed(total)


PIECES = "piece bigint, size int, key binary, at int, length int"


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    for batch in slices(batches, 1):
        made = [
            (int(piece_hashes(_codes(p), len(p)).view(np.int64)[0]), len(p), key, at, len(text))
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for p, at in pieces(text)
        ]
        columns = list(zip(*made)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in PIECES.split(", ")])


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """gid, item_id, first_char, last_char, distance for rows (gid, text), by joining pieces; nothing but a sieve is broadcast."""
    spark = rows.sparkSession
    items = items.select("item_id", "text").filter("text <> ''").withColumn("key", F.unhex(F.md5("text")))
    texts = cut(items.select("key", "text").distinct())
    known = cut(texts.mapInArrow(_pieces_of, PIECES))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # an item of 20 characters or more has pieces of 10 to 20
    # A sieve of 2 ** SIEVE_BITS bits, as rows of 4 KiB that have any.
    number = F.col("piece").bitwiseAND((1 << SIEVE_BITS) - 1)
    bits = known.select(F.bitmap_bucket_number(number).alias("b"), F.bitmap_bit_position(number).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    sieve = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for r in bits.toLocalIterator():
        part = np.frombuffer(r["m"], np.uint8)
        first = (r["b"] - 1) * len(part)
        # Bucket numbers start at 1 for bit 1, so bit 0 is the last of the bucket before.
        sieve[max(first, 0) : first + len(part)] |= part[max(-first, 0) :]
    held = spark.sparkContext.broadcast(sieve.tobytes())  # 2 ** (SIEVE_BITS - 3) bytes, whatever the benchmark

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint8)
        for batch in slices(batches, 1):
            for gid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = _codes(text or "")
                for size in sizes:
                    for a in range(0, len(codes) - size + 1, STRETCH):
                        hashes = piece_hashes(codes[a : a + STRETCH + size - 1], size)
                        low = (hashes & U((1 << SIEVE_BITS) - 1)).astype(np.int64) - 1
                        near = np.flatnonzero((low < 0) | (table[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool))
                        if len(near):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(hashes[near].view(np.int64)), pa.array(np.full(len(near), size, np.int32)), pa.array(np.full(len(near), gid, np.int64)), pa.array((near + a).astype(np.int32))],
                                names=["piece", "size", "gid", "pos"],
                            )

    found = rows.select("gid", "text").mapInArrow(grams, "piece bigint, size int, gid bigint, pos int")
    starts = found.join(known, ["piece", "size"]).select("gid", "key", "length", (F.col("pos") - F.col("at")).alias("start"))
    near = starts.groupBy("gid", "key", "length").agg(F.collect_set("start").alias("starts")).groupBy("gid").agg(F.collect_list(F.struct("key", "length", "starts")).alias("near"))
    names, kinds = ["gid", "key", "no", "at", "part"], (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            made = [
                (gid, n["key"], no, a, text[a:b])
                for gid, text, near in zip(*(c.to_pylist() for c in batch.columns))
                for n in near
                for no, (a, b) in enumerate(stretches(n["starts"], n["length"], budget(n["length"]), len(text)))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * 5, kinds)], names=names)

    spans = cut(rows.join(near, "gid").select("gid", "text", "near").mapInArrow(parts, "gid bigint, key binary, no int, at int, part string"))
    total = spans.count()
    counts = spans.groupBy("key").agg(F.count("*").alias("rows"))
    named = hot_join(spans, texts.join(counts, "key"), "key", "rows", total)

    @F.pandas_udf("struct<distance:int,first_char:int,last_char:int>")
    def closest(text, at, part):
        import pandas as pd

        made: dict[str, Item] = {}
        found = [made.setdefault(t, made.get(t) or Item(t)).closest([(a, p)]) for t, a, p in zip(text, at, part)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["distance", "first_char", "last_char"]).astype("Int32")

    best = named.select("gid", "key", "no", closest("text", "at", "part").alias("c")).filter("c.distance is not null")
    best = cut(best.groupBy("gid", "key").agg(F.min_by("c", F.struct("c.distance", "no")).alias("c")))
    total, counts = best.count(), best.groupBy("key").agg(F.count("*").alias("rows"))
    found = items.select("key", "item_id").join(counts.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list("item_id").alias("ids"))
    return hot_join(best, found.join(counts, "key"), "key", "rows", total).select("gid", F.explode("ids").alias("item_id"), "c.first_char", "c.last_char", "c.distance")


def leaks(docs: DataFrame, items: DataFrame, broadcast_chars: int | None = None) -> DataFrame:
    """doc_id, item_id, first_char, last_char, distance: each row's closest occurrence of each item within the budget.

    Texts are whole and compared as they are, by code points. The budget is EDITS of the item's length, rounded down; of
    equally close occurrences the first counts. Null and empty texts have no occurrences; repeated rows repeat theirs, and
    repeated items too; items that share a text are found alike. Empty tables give no rows, other columns are ignored.
    A benchmark of more than broadcast_chars characters (BLOCK_CHARS) is joined instead of broadcast.
    """
    if not _is_small(items, BLOCK_CHARS if broadcast_chars is None else broadcast_chars):
        rows = numbered(docs.select("doc_id", "text"))
        return _joined(rows, items).join(rows.select("gid", "doc_id"), "gid").select("doc_id", "item_id", "first_char", "last_char", "distance")
    held = _held(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, kinds = Finder(held.value), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in slices(batches, 1):
            hits = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) if t.is_valid for h in finder.find(t.as_py())]
            columns = list(zip(*hits)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "first_char", "last_char", "distance"])

    return docs.select("doc_id", "text").mapInArrow(run, HIT_SCHEMA)


def drop_leaks(docs: DataFrame, items: DataFrame, broadcast_chars: int | None = None) -> DataFrame:
    """The rows of `docs`, with their columns, in which no item occurs within its budget.

    Rows with null or empty texts stay, repeated rows stay or go together, no items drop nothing.
    """
    if not _is_small(items, BLOCK_CHARS if broadcast_chars is None else broadcast_chars):
        rows = numbered(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
        return rows.join(_joined(rows.select("gid", "text"), items).select("gid").distinct(), "gid", "left_anti").select("row.*")
    held, at = _held(items), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        for batch in slices(batches, at):
            yield batch.filter(pa.array([not (t.is_valid and finder.find(t.as_py())) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
