"""Two-stage suffix sorting of a byte string in memory, to a bounded depth, by numpy.

Suffixes that are smaller than their successors are sorted directly. The others are induced: while the buckets of first
bytes are scanned in order, each suffix found puts the one a byte before it, if that is larger, at the next place of its
bucket. A bucket holds its induced suffixes first, then its sorted ones.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
WORD = 8


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros past the end)."""
    padded = np.r_[text, np.zeros(WORD - 1, np.uint8)].astype(U)
    out = np.zeros(len(text), U)
    for k in range(WORD):
        out = (out << U(8)) | padded[k : k + len(text)]
    return out


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is, by convention (it starts with the separator)."""
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    turns = np.flatnonzero(step)
    out = np.ones(len(text), bool)
    nearest = np.searchsorted(turns, np.arange(len(text) - 1))
    inside = nearest < len(turns)
    out[:-1][inside] = step[turns[nearest[inside]]] > 0
    return out


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The places ordered by the `depth` bytes from there on, eight at a time; only ties are looked at again."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    for at in range(WORD, depth, WORD):
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        later = np.minimum(order[tied] + at, len(words) - 1)
        key = np.where(order[tied] + at < len(words), words[later], U(0))
        again = np.lexsort((key, group[tied]))
        order[tied] = order[tied][again]
        key, own = key[again], group[tied]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        new[tied[1:]] |= (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in the order of their first `depth` bytes at least, the words of words_at).

    The text must end with the separator 0. Suffixes that agree so far stand together, in any order.
    """
    words = words_at(text)
    is_small = smaller(text)
    direct = sort_directly(np.flatnonzero(is_small), words, depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~is_small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        ends = np.flatnonzero(np.r_[first[1:] != first[:-1], True]) + 1 if len(first) else []
        a = 0
        for b in ends:
            induced[first[a]].append(before[a:b])
            a = b

    for byte in range(256):
        while induced[byte]:
            found = np.concatenate(induced[byte])
            induced[byte] = []
            out.append(found)
            induce(found)
        found = direct[cuts[byte] : cuts[byte + 1]]
        if len(found):
            out.append(found)
            induce(found)
    return np.concatenate(out), words


def adjacent_alike(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each place agrees with the one before it in the list in the next `length` bytes (the first: no)."""
    alike = np.zeros(len(places), bool)
    left = np.arange(1, len(places))
    for at in [*range(0, length - WORD + 1, WORD), length - WORD]:
        left = left[words[places[left] + at] == words[places[left - 1] + at]]
    alike[left] = True
    return alike
