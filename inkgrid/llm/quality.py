"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is cut into short pieces (all of it, so that a dictionary counts as much at the end of a long text as at its
start); each piece is compressed with either dictionary. The difference of the two sums, as a share of the text's bytes,
goes through a logistic calibration that is fitted on texts no dictionary has seen. Mere repetition is small under both
dictionaries, so its difference is no good text's.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.llm.words import slices

#: Bounds of what the classifier is fitted on: labelled texts of each class, and characters of a text, from all its length.
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 20_000
PIECE = 512
LEVEL = 3
DICT_BYTES = 112_640
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries as bytes, and the calibration; without both classes a constant score."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()
    constant: float = 0.5


class _Sizes:
    """Compressed sizes of a text under a model's two dictionaries."""

    def __init__(self, model: Model):
        self.by = [self._compressor(d) for d in (model.good, model.bad)]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(data)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def difference(self, text: str | None) -> float:
        raw = (text or "").encode()
        pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)] or [b""]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.by)
        return (bad - good) / max(1, len(raw))


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, on standardised columns, for the raw ones."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = _expand((x - mean) / spread)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = _squash(z @ w)
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return np.concatenate([[w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread])


def _squash(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def held_out(doc_id) -> F.Column:
    """Rows kept from all fitting: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(text) -> F.Column:
    """The text, or pieces of one longer than SAMPLE_CHARS, spread evenly from its start to its end."""
    size, n = F.char_length(text), SAMPLE_CHARS // PIECE
    start = lambda k: (k.cast("long") * (size - PIECE) / (n - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(text, start(k), F.lit(PIECE)))
    return F.when(size <= SAMPLE_CHARS, text).otherwise(F.array_join(pieces, ""))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most SAMPLE_PER_CLASS labelled texts of each class (1 good, 0 bad), by hash of the id; never on held-out rows.

    Only labels of rows with a text count; long texts are sampled over all their length. Null labels and ids are
    ignored; of several labels of an id the worst counts. One half of the sample makes the
    dictionaries, the other the calibration. If either class is missing or too small for a dictionary, every score is
    the share of good labels in the sample (0.5 without labels).
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = docs.filter(F.char_length("text") > 0).select("doc_id", "text")
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for q in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * SAMPLE_PER_CLASS rows
    texts = docs.join(ids, "doc_id").withColumn("text", sampled(F.col("text")))
    got = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    got = [(r["quality"], r["text"]) for r in sorted(got, key=lambda r: (r["doc_id"] * 2654435761) % (1 << 32))]
    share = sum(q for q, _ in got) / len(got) if got else 0.5
    halves = [[[t for q, t in got if q == c][k::2] for k in (0, 1)] for c in (0, 1)]
    dictionaries = []
    for first, second in halves:
        raw = [t.encode() for t in first]
        pieces = [t[k : k + PIECE] for t in raw for k in range(0, len(t), PIECE)]
        if len(pieces) < 20 or len(second) < 5:
            return Model(constant=share)
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 4)), pieces).as_bytes())
        except zstandard.ZstdError:
            return Model(constant=share)
    bad, good = dictionaries
    sizes = _Sizes(Model(good, bad))
    rows = [(c, sizes.difference(t)) for c in (0, 1) for t in halves[c][1]]
    w = _logistic(np.array([[f] for _, f in rows]), np.array([c for c, _ in rows], dtype=float))
    return Model(good, bad, tuple(w), share)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score (0 to 1, higher: likelier good) and predicted (1 from THRESHOLD up) to every row; keeps all columns.

    A null or empty text gets the score of an empty piece; equal texts get equal scores. Columns that have the two names
    in `docs` are replaced; other names can be given. No rows give no rows.
    """
    docs = docs.drop(*names)
    fields = docs.schema.names
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model) if model.weights else None
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            if sizes:
                x = np.array([sizes.difference(t) for t in texts]).reshape(len(texts), 1)
                s = _squash(_expand(x) @ np.array(model.weights))
            else:
                s = np.full(len(texts), model.constant)
            predicted = (s >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(predicted)], names=[*fields, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns as they are; all rows if none could be fitted.

    Repeated rows stay or go together; a null or an empty text goes by the score of an empty piece.
    """
    free = [n for n in (f"__own{k}" for k in range(len(docs.columns) + 2)) if n not in docs.columns]
    names = (free[0], free[1])
    model = fit(docs, labels)
    if not model.weights:
        logging.getLogger(__name__).warning("too few labelled texts of both classes for a classifier: no document is rejected")
        return docs
    return score(docs, model, names).filter(F.col(names[1]) == 1).select(*docs.columns)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, repeated ones and null ids (never held out) too."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
