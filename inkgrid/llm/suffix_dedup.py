"""Suffix-array deduplication: every byte under a 100-byte string that also starts earlier is removed.

The suffixes of a whole corpus do not fit a shuffle, so three steps narrow them down without losing any:

1. Each window of WINDOW bytes has an anchor, the GRAM-byte string in it of the least hash. Equal windows have equal
   anchors in the same place, so only windows whose anchor occurs again can repeat. The windows that follow each other
   with one anchor make a stretch.
2. Stretches are dealt by their anchor. Of stretches that are equal altogether the first stays and the others' windows
   are repeats; an anchor that then has one stretch left is done. Equal are those with one BLAKE2b digest of all their
   bytes, a cryptographic one: hashes that texts can be made to collide in decide about work only.
3. The stretches left of all other anchors are cut out of the texts, dealt by anchor and, some at a time, joined to one
   string, whose suffixes are sorted (two-stage, see suffix_sort); windows that stand next to each other and agree in
   WINDOW bytes are equal, and all but the first in the corpus are repeats.

Anchors that a very common passage makes too heavy for one task are found on a sample first; their windows are dealt by
window instead. That changes where work is done, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.llm.common import cut, numbered, partitions, plain_ids
from inkgrid.llm.suffix_sort import adjacent_alike, suffix_array
from inkgrid.llm.words import BLOCK, Powers, U, slices, text_bytes

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Bytes whose suffixes are sorted at once, unless one anchor's stretches are more.
SORTED_BYTES = 1 << 19
#: Anchors with more than this share of all stretches are heavy; there are fewer than 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1e-5
HEAVY_LEAST = 1000
SAMPLE_ONE_IN = 16
#: Bytes of stretch records that a task of step 2 holds at once, on average.
BUCKET_BYTES = 32 << 20

FOUND, REPEAT, OPEN = 0, 1, 2
STRETCH_SCHEMA = "kind tinyint, bucket int, gid bigint, start int, n int, anchor bigint, data binary"
_names = [f.split()[0] for f in STRETCH_SCHEMA.split(", ")]
_kinds = (pa.int8(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
_record = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("whole2", "<u8"), ("gid", "<i8"), ("start", "<i4"), ("n", "u1")])
_long = np.dtype([(name, "<i4" if name == "n" else _record[name]) for name in _record.names])
_made: dict[int, Powers] = {}


def _powers(seed: int) -> Powers:
    if seed not in _made:
        _made[seed] = Powers(BLOCK + WINDOW, seed)
    return _made[seed]


def _stretches_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, by_window: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in data, windows, anchor hash, digest of all in two numbers) of the rows data[begin:end], in order of place.

    Stretches of the anchors in `by_window` (sorted) are split into single windows, whose hash serves as anchor.
    """
    lengths = end - begin
    some = np.flatnonzero(lengths >= WINDOW)
    if not len(some):
        return (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U)), np.zeros((0, 2), U))
    one = _powers(3)
    sums = one.prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = one.stretch(sums, at, at + GRAM)
    low = U((1 << 21) - 1)
    least = (grams & ~low) | at.astype(U)
    span = 1
    while span < SPAN:
        step = min(span, SPAN - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, begin[some], 1)
    np.add.at(valid, end[some] - WINDOW + 1, -1)
    place = np.flatnonzero(np.cumsum(valid[:-1]))
    anchor = (least[place] & low).astype(np.int64)
    fresh = np.r_[True, (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1])]
    first = np.flatnonzero(fresh)
    start, n = place[first], np.diff(np.r_[first, len(place)])
    key = grams[anchor[first]]
    if len(by_window):
        k = np.minimum(np.searchsorted(by_window, key), len(by_window) - 1)
        heavy = by_window[k] == key
        times = np.where(heavy, n, 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, n, key, heavy = np.repeat(start, times) + step, np.where(np.repeat(heavy, times), 1, np.repeat(n, times)), np.repeat(key, times), np.repeat(heavy, times)
        key = np.where(heavy, one.stretch(sums, start, start + WINDOW), key)
    raw = data.tobytes()
    digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + n + WINDOW - 1).tolist())])
    whole = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return np.searchsorted(begin, start, "right") - 1, start, n, key, whole


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of at most BLOCK bytes: (first byte, last, row numbers, their begin and end in the block); long rows overlap."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        if offsets[row + 1] - offsets[row] <= BLOCK:
            to = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
            first, ids = int(offsets[row]), np.arange(row, to)
            yield first, int(offsets[to]), ids, offsets[row:to] - first, offsets[row + 1 : to + 1] - first
            row = to
        else:
            for first in range(int(offsets[row]), int(offsets[row + 1]) - WINDOW + 1, BLOCK):
                last = min(first + BLOCK + WINDOW - 1, int(offsets[row + 1]))
                yield first, last, np.array([row]), np.array([0]), np.array([last - first])
            row += 1


def _records(column: pa.Array, gids: np.ndarray, by_window: np.ndarray) -> np.ndarray:
    """The stretches of all rows of a batch."""
    data, offsets = text_bytes(column)
    out = []
    for first, last, ids, begin, end in _blocks(offsets):
        row, start, n, key, whole = _stretches_of(data[first:last], begin, end, by_window)
        part = np.zeros(len(row), _record)
        part["anchor"], part["whole"], part["whole2"], part["gid"], part["n"] = key, whole[:, 0], whole[:, 1], gids[ids[row]], n
        part["start"] = start + first - offsets[ids[row]]
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, _record)


def _ordered(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records by anchor, whole, gid, start; and which are the first of their anchor and whole."""
    records = records[np.lexsort((records["start"], records["gid"], records["whole2"], records["whole"], records["anchor"]))]
    same = np.logical_and.reduce([records[f][1:] == records[f][:-1] for f in ("anchor", "whole", "whole2")])
    return records, np.r_[np.ones(min(1, len(records)), bool), ~same]


def _joined(records: np.ndarray) -> np.ndarray:
    """Stretches of a text that follow each other as one (anchor and whole lose their meaning)."""
    if not len(records):
        return records.astype(_long)
    records = records[np.lexsort((records["start"], records["gid"]))]
    fresh = np.r_[True, (records["gid"][1:] != records["gid"][:-1]) | (records["start"][1:] != records["start"][:-1] + records["n"][:-1])]
    first = np.flatnonzero(fresh)
    out = records[first].astype(_long)
    out["n"] = np.add.reduceat(records["n"].astype(np.int32), first)
    return out


def _rows(kind: int, records: np.ndarray, bucket: np.ndarray | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(records)
    columns = (np.full(n, kind, np.int8), np.zeros(n, np.int32) if bucket is None else bucket, records["gid"], records["start"], records["n"].astype(np.int32), records["anchor"].view(np.int64))
    arrays = [pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, _kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())], names=_names)


def _find(buckets: int, by_window: np.ndarray):
    """From rows (gid, text): a batch's stretches packed for each bucket, and the repeats that show within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 64 * BLOCK):
            gids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            records, first = _ordered(_records(batch.column(1), gids, by_window))
            repeats = _joined(records[~first])
            yield _rows(REPEAT, repeats, (repeats["gid"].astype(U) % U(buckets)).astype(np.int32))
            records = records[first]
            bucket = (records["anchor"] % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            packed = [b"".join(np.ascontiguousarray(part[f]).tobytes() for f in _record.names) for part in np.split(records, cuts[1:])] if len(cuts) else []
            yield _rows(FOUND, np.zeros(len(cuts), _record), bucket[cuts], packed)

    return run


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // _record.itemsize
    out, at = np.zeros(n, _record), 0
    for name in _record.names:
        kind = _record[name]
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; of each bucket the repeats, and what must be compared byte by byte (kind OPEN)."""

    def settled(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        records, first = _ordered(np.concatenate([_unpack(p) for p in parts]))
        yield _rows(REPEAT, _joined(records[~first]))
        records = records[first]
        again = records["anchor"][1:] == records["anchor"][:-1]
        yield _rows(OPEN, records[np.r_[False, again] | np.r_[again, False]])

    bucket, parts = None, []
    for batch in batches:
        found = np.asarray(batch.column(0)) == FOUND
        yield batch.filter(pa.array(~found))
        for b, data in zip(batch.column(1).filter(pa.array(found)).to_pylist(), batch.column(6).filter(pa.array(found)).to_pylist()):
            if b != bucket and parts:
                yield from settled(parts)
                parts = []
            bucket = b
            parts.append(data)
    if parts:
        yield from settled(parts)


CUT_SCHEMA = "anchor bigint, gid bigint, start int, n int, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (gid, text, open): the bytes of each open stretch."""
    names = [f.split()[0] for f in CUT_SCHEMA.split(", ")]
    for batch in slices(batches, 1):
        data, offsets = text_bytes(batch.column(1))
        held = batch.column(2)
        flat, sizes = held.flatten(), np.diff(held.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
        gid = batch.column(0).to_numpy(zero_copy_only=False)[row]
        raw = data.tobytes()
        pieces = [raw[a : a + k + WINDOW - 1] for a, k in zip((offsets[row] + start).tolist(), n.tolist())]
        columns = (flat.field("anchor"), pa.array(gid, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(pieces, pa.binary()))
        yield pa.RecordBatch.from_arrays(list(columns), names=names)


SPAN_SCHEMA = "gid bigint, start int, n int"


def repeated_windows(gid: np.ndarray, start: np.ndarray, n: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gid, first window, windows) of all windows of the stretches that equal an earlier one of them."""
    lengths = n + WINDOW  # a separator 0 ends each; UTF-8 has no byte 255, so all bytes move up by one
    text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
    base = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(n)), lengths)
    offset = np.arange(len(text)) - base[owner]
    places, words = suffix_array(text, WINDOW)
    places = places[offset[places] < n[owner[places]]]
    run = np.cumsum(~adjacent_alike(places, words, WINDOW))
    who, when = gid[owner[places]], start[owner[places]] + offset[places]
    order = np.lexsort((when, who, run))
    later = np.r_[False, run[order][1:] == run[order][:-1]]
    hit = np.zeros(len(text), bool)
    hit[places[order[later]]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return gid[:0], start[:0], n[:0]
    fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
    return gid[owner[at[fresh]]], start[owner[at[fresh]]] + offset[at[fresh]], np.diff(np.r_[fresh, len(at)])


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are gathered up to SORTED_BYTES and compared."""
    names = [f.split()[0] for f in SPAN_SCHEMA.split(", ")]

    def compared(table: pa.Table) -> pa.RecordBatch:
        gid, start, n = (table.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
        made = repeated_windows(gid, start, n, table.column(4).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.int32(), pa.int32()))], names=names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            held.append(batch)
            batch = batch.slice(batch.num_rows)
            if sum(b.column(4).nbytes for b in held) >= SORTED_BYTES:
                table = pa.Table.from_batches(held)
                anchor = table.column(0).to_numpy()
                whole = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
                if whole:
                    yield compared(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield compared(pa.Table.from_batches(held))


def heavy_anchors(rows: DataFrame, total: int) -> np.ndarray:
    """Of texts of `total` bytes, hashes of the anchors that hold over HEAVY_SHARE of all stretches (HEAVY_LEAST at least), by a sample of texts."""
    schema = "anchor bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            gids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            records, first = _ordered(_records(batch.column(1), gids, np.zeros(0, U)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records["anchor"][first]).view(np.int64))], names=["anchor"])

    sampled = rows.filter(F.pmod(F.xxhash64("gid"), F.lit(SAMPLE_ONE_IN)) == 0).mapInArrow(run, schema)
    counts = sampled.groupBy("anchor").count()
    least = max(HEAVY_LEAST, HEAVY_SHARE * total * 2 / (SPAN + 1)) / SAMPLE_ONE_IN
    most = int(2 / HEAVY_SHARE)  # no more can be heavy
    found = [r["anchor"] for r in counts.filter(F.col("count") >= least).orderBy(F.desc("count")).limit(most).collect()]
    return np.sort(np.array(found, np.int64).view(U))


def repeats(rows: DataFrame) -> DataFrame:
    """(gid, start, n): windows start .. start+n-1 of a text repeat earlier ones; for rows (gid, text) with unique gids."""
    texts = rows.select("gid", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8 * partitions(rows.sparkSession), -(-total * 2 * _record.itemsize // ((SPAN + 1) * BUCKET_BYTES)))
    found = texts.mapInArrow(_find(buckets, heavy_anchors(texts, total)), STRETCH_SCHEMA)
    settled = cut(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle, STRETCH_SCHEMA).select("kind", "gid", "start", "n", "anchor"))
    open_ = settled.filter(F.col("kind") == OPEN).groupBy("gid").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("open"))
    pieces = texts.join(open_, "gid").select("gid", "text", "open").mapInArrow(_cut_out, CUT_SCHEMA)
    compared = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_suffixes, SPAN_SCHEMA)
    return settled.filter(F.col("kind") == REPEAT).select("gid", "start", "n").unionByName(compared)


def removed_mask(size: int, spans: np.ndarray) -> np.ndarray:
    """Which of `size` bytes the spans (first byte, end) cover."""
    turn = np.zeros(size + 1, np.int64)
    np.add.at(turn, spans[:, 0], 1)
    np.add.at(turn, spans[:, 1], -1)
    return np.cumsum(turn[:-1]) > 0


MADE = (("kept", T.BinaryType(), pa.binary()), ("kept_text", T.StringType(), pa.string()), ("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()))


def _cleared(rows: DataFrame, *wanted: str) -> DataFrame:
    """Rows with unique gids, and a text, with those columns of MADE added that are wanted."""
    made_fields = [f for f in MADE if f[0] in wanted]
    spans = repeats(rows).select("gid", F.struct("start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end")).alias("span"))
    spans = spans.groupBy("gid").agg(F.collect_list("span").alias("spans"))
    joined = rows.join(spans, "gid", "left").select(*rows.columns, "spans")
    out = T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for name, kind, _ in made_fields)])
    text = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = {name: [] for name, _, _ in MADE}
            for value, found in zip(batch.column(text).to_pylist(), batch.columns[-1].to_pylist()):
                raw = kept = (value or "").encode()
                runs = 0
                if found:
                    gone = removed_mask(len(raw), np.array([(s["start"], s["end"]) for s in found]))
                    runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                made["kept"].append(kept)
                made["kept_text"].append(kept.decode(errors="ignore") if found else value)
                for name, count in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", runs)):
                    made[name].append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[name], k) for name, _, k in made_fields)], names=out.names)

    return joined.mapInArrow(run, out)


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the columns MADE in every row; columns of these names, or `gid`, are replaced.

    kept is what is left of the text, in bytes; kept_text is the same as text, without the rest of a character that a cut
    splits; n_bytes, n_removed and n_spans count the bytes, those gone, and the maximal runs of these.

    A byte goes if a WINDOW-byte string over it also starts earlier: in a row of smaller doc_id (null ids come first, rows
    that share an id are ordered by text; of equal rows one is the earlier) or further left in the same text. Strings are
    taken from the input, not from what is left, and never cross texts. Null texts count as empty.
    """
    names = [name for name, _, _ in MADE]
    return _cleared(numbered(docs.drop("gid", "spans", *names)), *names).drop("gid")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`, by the rules of dedup."""
    docs = docs.select("doc_id", "text")
    plain = plain_ids(docs)
    rows = numbered(docs, plain=plain)
    # Where doc_id itself numbers the rows it need not travel twice, and both joins with the texts share one exchange.
    wanted = ("kept", "n_bytes", "n_removed", "n_spans")
    found = _cleared(rows.select("gid", "text"), *wanted).withColumnRenamed("gid", "doc_id") if plain else _cleared(rows, *wanted)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, whose texts are cut to what is left; rows that lose all their text go.

    n_chars, if there, is counted anew where a text is cut.
    """
    extra = [c for c in ("gid", "spans", *(name for name, _, _ in MADE)) if c in docs.columns]
    hidden = {c: f"__own_{c}" for c in extra}
    found = _cleared(numbered(docs.withColumnsRenamed(hidden)), "kept_text", "n_removed")
    cut_ = F.col("n_removed") > 0
    found = found.filter(~cut_ | (F.col("kept_text") != "")).withColumn("text", F.when(cut_, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut_, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.drop("gid", "kept_text", "n_removed").withColumnsRenamed({v: k for k, v in hidden.items()}).select(*docs.columns)
