"""SentencePiece segmentation by additive scores (unigram models) as a max-plus parallel scan.

A giant text is cut into chunks. How far a piece reaches over a cut, 0 to LONGEST-1 characters, is the cut's state; a chunk
turns into a matrix of the best scores from each state at its start to each at its end. Matrices combine associatively by
max-plus products, which gives the state at each cut on the best path; then every chunk is traced back by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import numbered

CHUNK = 1 << 16
#: What a character that no piece covers costs more than the worst piece.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces by text with id and score; `unknown` is the id of a character that has none."""

    def __init__(self, scores: list[tuple[str, float]], unknown: int = 0):
        self.by_text = {p: (k, s) for k, (p, s) in enumerate(scores) if p}
        self.longest = max(map(len, self.by_text), default=1)
        self.unknown = (unknown, min((s for _, s in scores), default=0.0) - UNKNOWN_PENALTY)

    def starting(self, text: str, at: int) -> Iterator[tuple[int, int, float]]:
        """(length, id, score) of the pieces at a place; a lone character is unknown if it is none."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            found = self.by_text.get(text[at : at + n])
            if found:
                yield n, *found
            elif n == 1:
                yield 1, *self.unknown

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best scores from state i to state j over the first `size` characters; `text` has what follows, as far as pieces reach."""
        w = self.longest
        best = np.full((size + w, w), -np.inf)
        best[np.arange(w), np.arange(w)] = 0.0
        for at in range(size):
            if np.isfinite(best[at]).any():
                for n, _, score in self.starting(text, at):
                    np.maximum(best[at + n], best[at] + score, out=best[at + n])
        return best[size : size + w].T.copy()

    def trace(self, text: str, size: int, first: int, last: int) -> list[int]:
        """The ids of the best path from state `first` to state `last`; ties go to the shorter last piece."""
        score = np.full(size + self.longest, -np.inf)
        came: dict[int, tuple[int, int]] = {}
        if first >= size:
            return []
        score[first] = 0.0
        for at in range(first, size):
            if score[at] > -np.inf:
                for n, k, s in self.starting(text, at):
                    if score[at] + s > score[at + n]:
                        score[at + n], came[at + n] = score[at] + s, (at, k)
        out, at = [], size + last
        while at > first:
            at, k = came[at]
            out.append(k)
        return out[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, state after) of each chunk on the best path from state 0 to state 0.

    Neighbours are combined two by two up to the whole; from there down, the state between two halves hangs on nothing but
    the states at their outer ends.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)])
    ends = [(0, 0)]
    for level in reversed(levels[:-1]):
        below = []
        for k, (a, b) in enumerate(ends):
            if 2 * k + 1 < len(level):
                between = int(np.argmax(level[2 * k][a] + level[2 * k + 1][:, b]))
                below += [(a, between), (between, b)]
            else:
                below.append((a, b))
        ends = below
    return ends


def encode(docs: DataFrame, pieces: Pieces, chunk: int = CHUNK, text: str = "text") -> DataFrame:
    """(gid, ids) of every row, by the greatest sum of scores; gid as common.numbered gives it. Null and empty texts have no ids."""
    rows = numbered(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))).select("gid", "text")
    reach = pieces.longest - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(g, k // chunk, min(chunk, len(t) - k), t[k : k + chunk + reach]) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in range(0, len(t), chunk)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["gid", "no", "size", "text"])

    @F.pandas_udf("binary")
    def transfer(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([pieces.matrix(t, n).tobytes() for t, n in zip(texts, sizes)])

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def scan(lists: pd.Series) -> pd.Series:
        w = pieces.longest
        return pd.Series([[{"first": a, "last": b} for a, b in states([np.frombuffer(m, np.float64).reshape(w, w) for m in found])] for found in lists])

    @F.pandas_udf("array<int>")
    def traced(texts: pd.Series, sizes: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([pieces.trace(*row) for row in zip(texts, sizes, first, last)])

    chunks = rows.mapInArrow(cut, "gid bigint, no int, size int, text string")
    # A text's matrices are LONGEST squared numbers a chunk: some hundredths of the text.
    moved = chunks.select("gid", "no", transfer("text", "size").alias("m")).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("no", "m"))).alias("ms"))
    at = moved.select("gid", F.posexplode(scan(F.transform("ms", lambda x: x["m"]))).alias("no", "s")).select("gid", "no", "s.first", "s.last")
    done = chunks.join(at, ["gid", "no"]).select("gid", "no", traced("text", "size", "first", "last").alias("ids"))
    ids = done.groupBy("gid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("gid").join(ids, "gid", "left").select("gid", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
