"""SentencePiece encoding and decoding with a given model; the ids are the library's.

The public model merges pairs by rank (BPE). Its result is not the path of the greatest score sum, so a max-plus product
over chunks gives other ids (README has figures; maxplus.py has the scan, for models whose scores add up). What holds
instead: no piece of the model has a blank behind another character, so at every blank that follows another character the
only boundary state is "no piece crosses" and chunks join by mere concatenation. Giant texts are cut there into segments,
which are dealt over tasks, encoded and decoded each by itself, and put together again. Within a segment, equal units are
encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units whose ids a task remembers, and the longest unit that it does.
REMEMBERED, UNIT_CHARS = 400_000, 64
#: Bytes from which on a text is cut into segments of about as many characters.
SEGMENT = 1 << 20

_units = re.compile(" +[^ ]*")
_cuts = re.compile("(?<=[^ ]) ")
BLANK = "▁"


class Codec:
    """Encodes and decodes with one model; made once in a task."""

    def __init__(self, model: str = MODEL):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.cuttable = not any(BLANK in p.lstrip(BLANK) for p in pieces) and BLANK in pieces and self.model.encode("x y") == self.model.encode("x") + self.model.encode("y")
        self.known: dict[str, list[int]] = {}
        self.blank = [pieces.index(BLANK)] if BLANK in pieces else []

    def encode(self, text: str | None, inside: bool = False) -> list[int]:
        """The ids of a text, or of a segment inside one, which begins with a blank."""
        if not text:
            return []
        if BLANK in text or not self.cuttable:
            return self.model.encode(text)
        units = _units.findall(text if inside else " " + text)
        known = self.known
        new = [u for u in dict.fromkeys(units) if u not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(units))
            made = self.model.encode([u[1:] for u in new], num_threads=1)
            known.update(zip(new, made))
            known[" "] = self.blank
        out: list[int] = []
        for u in units:
            out += known[u]
        for u in new:
            if len(u) > UNIT_CHARS:
                known.pop(u, None)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def segments(text: str, size: int) -> Iterator[str]:
    """The text cut at blanks behind other characters, into segments of `size` characters or the next such blank."""
    at = 0
    while at < len(text):
        found = _cuts.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def _appended(df: DataFrame, out: str, kind: T.DataType, of: str, work) -> DataFrame:
    """`df` with the column `out`, made from the column `of`; a column of that name is replaced."""
    df = df.drop(out) if out != of else df
    at, names = df.columns.index(of), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(work[1])
        for batch in slices(batches, at) if work[0] == "encode" else batches:
            made = [None if v is None else getattr(codec, work[0])(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()) if work[0] == "encode" else pa.string())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the piece ids of each text; null for null, none for an empty text. All rows and other columns stay as they are."""
    return _appended(docs, out, T.ArrayType(T.IntegerType()), text, ("encode", model))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids; null for null. All rows and other columns stay as they are."""
    return _appended(rows, out, T.StringType(), ids, ("decode", model))


def _finished(texts: list[str | None], ids: list[np.ndarray], back: list[str], shown: str) -> list[pa.Array]:
    """The columns of `encoded` beside doc_id."""
    return [
        pa.array(map(len, ids), pa.int32()),
        pa.array(ids, pa.list_(pa.int32())),
        pa.array(texts if shown == "text" else back, pa.string()),
        pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
        pa.array([(t or "") == b for t, b in zip(texts, back)], pa.bool_()),
    ]


def encoded(docs: DataFrame, model: str = MODEL, shown: str = "decoded", segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_pieces, ids, the text `shown` (`decoded`, or `text` as it came), ids_sha256, decoded_sha256, round_trip.

    A row for each row of `docs`, repeated ones too; an empty table gives no rows, other columns are ignored. For the digest
    the ids count as little-endian 32-bit numbers. A null text has no pieces and counts as empty, but `text` stays null. A
    text that holds the model's blank sign U+2581 itself decodes to a space there, so it is no round trip. Texts of more
    than `segment` bytes are dealt over tasks in segments, if the model has cuts and the text is without that sign.
    """
    schema = f"doc_id bigint, n_pieces int, ids array<int>, {shown} string, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = [np.array(codec.encode(t), "<i4") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_finished(texts, ids, [codec.decode(i.tolist()) for i in ids], shown)], names=names)

    rows = docs.select("doc_id", "text")
    if not Codec(model).cuttable:
        return rows.mapInArrow(run, schema)
    giant = F.coalesce((F.octet_length("text") > segment) & ~F.contains("text", F.lit(BLANK)), F.lit(False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, part in enumerate(segments(text, segment)):
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((doc, key, n, no, part), kinds)], names=["doc_id", "key", "n", "no", "part"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in slices(batches, 4):
            ids = [codec.encode(p, no > 0) for no, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            # Inside a text the blank that a segment begins with is a character, not the one put before the first word.
            back = [(" " if no else "") + codec.decode(i) for no, i in zip(batch.column(3).to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=[*batch.schema.names, "ids", "back"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, parts in zip(*(c.to_pylist() for c in batch.columns)):
                text, back, ids = "".join(p["part"] for p in parts), "".join(p["back"] for p in parts), np.concatenate([np.array(p["ids"], "<i4") for p in parts])
                for _ in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *_finished([text], [ids], [back], shown)], names=names)

    held = rows.filter(giant).groupBy("doc_id", F.md5("text").alias("key")).agg(F.count("*").alias("n"), F.any_value("text").alias("text"))
    parts = held.mapInArrow(cut, "doc_id bigint, key string, n bigint, no int, part string").repartition("key", "no")
    made = parts.mapInArrow(each, "doc_id bigint, key string, n bigint, no int, part string, ids array<int>, back string")
    whole = made.groupBy("doc_id", "key", "n").agg(F.array_sort(F.collect_list(F.struct("no", "part", "ids", "back"))).alias("parts"))
    return rows.filter(~giant).mapInArrow(run, schema).unionByName(whole.select("doc_id", "n", "parts").mapInArrow(joined, schema))


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """What `encoded` gives, without the ids and the text."""
    return encoded(docs, model).drop("ids", "decoded")
