"""Words, shingles and substrings of whole Arrow batches as 64-bit hashes, by numpy.

Hashes are polynomial over random byte values, so that the hash of any stretch is a difference of two prefix sums, then
mixed. They are the same in every process and for every way of cutting rows into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes handled at once; longer texts are cut between words.
BLOCK = 1 << 18
U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed) * U(0xD1342543DE82EF95))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(32))


class Powers:
    """Powers of an odd base and of its inverse, up to a length, and the random values of bytes."""

    def __init__(self, length: int, seed: int):
        base = int(splitmix(1, seed)[0]) | 1
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.r_[U(1), np.full(length, base, U)], dtype=U)
            self.down = np.cumprod(np.r_[U(1), np.full(length, pow(base, -1, 1 << 64), U)], dtype=U)
        self.byte = splitmix(256, seed + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of byte value times power before each position, one longer than data."""
        sums = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(self.byte[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], wherever they stand."""
        with np.errstate(over="ignore"):
            return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U))


def blank_table() -> np.ndarray:
    """Bytes as they are, ASCII white space and controls as 0: words are what stands between."""
    table = np.arange(256, dtype=np.uint8)
    table[:33] = 0
    return table


def plain_table() -> np.ndarray:
    """Lower case; of ASCII only letters and digits count, other signs part words."""
    table = np.arange(256, dtype=np.uint8)
    for k in range(128):
        table[k] = ord(chr(k).lower()) if chr(k).isalnum() else 0
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and where each row starts (null: empty)."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8), offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 16 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `limit` bytes of text, or one row: what is held at once stays bounded."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def blocks(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Cuts a batch into blocks of mapped bytes: (block, row starts in it, its first byte). A cut falls between rows or words."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            row = np.searchsorted(offsets, to, "right") - 1
            if offsets[row] > at:
                to = int(offsets[row])
            else:
                gap = np.flatnonzero(table[data[at:to]] == 0)
                if len(gap):
                    to = at + int(gap[-1]) + 1
                else:
                    last = int(offsets[row + 1])
                    gap = np.flatnonzero(table[data[to:last]] == 0)
                    to = to + int(gap[0]) if len(gap) else last
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)]
        yield table[data[at:to]], inside - at, at
        at = to


class Words:
    """Hashes of all words of a batch, in order; `counts` has how many each row has."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        data, offsets = text_bytes(column)
        hashes, places = [], []
        for b, starts, first in blocks(data, offsets, table):
            powers = _powers(len(b))
            word = b != 0
            before = np.r_[False, word[:-1]]
            before[starts[starts < len(b)]] = False
            after = np.r_[word[1:], False]
            after[starts[(starts > 0) & (starts < len(b))] - 1] = False
            s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
            hashes.append(powers.stretch(powers.prefix(b), s, e))
            places.append(s + first)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.ends = np.searchsorted(self.places, offsets[1:])
        self.counts = np.diff(np.r_[0, self.ends])

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, counts, first word of each): runs of `size` words; a row of fewer words, but some, has one of all its words."""
        w, n = self.hashes, len(self.hashes)
        turn = splitmix(size, 77) | U(1)
        start = np.repeat(self.ends - self.counts, self.counts)
        short = (self.counts < size) & (self.counts > 0)
        at = np.arange(n)
        counts = np.where(short, 1, np.maximum(self.counts - size + 1, 0))
        valid = at - start <= np.repeat(np.where(short, 0, self.counts - size), self.counts)
        padded = np.r_[w, np.zeros(size - 1, U)]
        length = np.repeat(np.minimum(self.counts, size), self.counts)
        with np.errstate(over="ignore"):
            total = padded[:n] * turn[0]
            for k in range(1, size):
                total += np.where(k < length, padded[k : n + k] * turn[k], U(0))
            total += length.astype(U)
        return mixed(total[valid]), counts, at[valid]


_made: dict[int, Powers] = {}


def _powers(length: int) -> Powers:
    """One table for all blocks of usual size, a passing one for longer."""
    if length <= BLOCK:
        if BLOCK not in _made:
            _made[BLOCK] = Powers(BLOCK, 1)
        return _made[BLOCK]
    return Powers(length, 1)
