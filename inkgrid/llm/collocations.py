"""Phrases that occur more often than their parts would let expect, mined level by level (Apriori).

Words are counted first. Every further pass over the texts counts the phrases of one more word, and only those whose first words
and whose last words are both frequent: these are broadcast from the level before and numbered, so that a phrase is a pair of
numbers and no text is shuffled. A level of too many phrases is broadcast as a sieve instead, and its successors are counted as
texts. The levels' tables then give each way of cutting a phrase in two its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import cut, hot_join, partitions
from inkgrid.llm.words import Powers, U, mixed, slices, splitmix, text_bytes

#: Most words of a phrase, fewest occurrences, rows for each language, and the share in a hundred of a phrase's occurrences that a
#: longer phrase must account for to stand in its place.
MOST, LEAST, TOP, COVER = 5, 100, 2000, 100
NO_LANG = "und"
#: Bytes of text that are counted at once; longer texts are read in segments that share words.
SEGMENT = 1 << 20
#: At most so many frequent phrases of a level are broadcast and numbered; more go into a sieve of 2^SIEVE_BITS bits.
EXACT, SIEVE_BITS = 1 << 20, 28
#: A segment's words are looked up by a table of languages times words up to this size, else by sorting.
TABLE = 1 << 24
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
COUNTS = "lang string, phrase string, f bigint"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, and what each is: 0 of a word, 1 blank, 2 the end of a piece."""
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    lower[65:91] += 32
    kind[list(BLANKS)], kind[list(PIECE_ENDS)] = 1, 2
    return lower, kind


LOWER, KIND = _tables()
_TURN = splitmix(MOST + 1, 91) | U(1)


def _hash(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their words and of their language."""
    with np.errstate(over="ignore"):
        total = lang * _TURN[MOST]
        for w, turn in zip(words, _TURN):
            total = total + w * turn
        return mixed(total + U(len(words)))


_powers: dict[int, Powers] = {}


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of strings by their bytes, the same wherever they stand."""
    data, offsets = text_bytes(words)
    length = 1 << max(16, (len(data) - 1).bit_length())
    powers = _powers.get(length) or Powers(length, 17)
    if length <= 4 * SEGMENT:
        _powers[length] = powers
    return powers.stretch(powers.prefix(data), offsets[:-1], offsets[1:])


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in the sorted keys; -1 if it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Numbered:
    """The frequent phrases of the levels so far, each by its place in its level: of words in the order of their hashes, of longer phrases in that of their pairs."""

    def __init__(self):
        self.langs: list[pa.Array] = []
        self.phrases: list[pa.Array] = []
        self.keys: list[np.ndarray] = []
        self.spaced: pa.Array | None = None  # the words with one blank behind, as segments have them

    def take(self, level: DataFrame) -> bool:
        """Adds a level's table (lang, phrase, key); not if two words have one hash, so that numbers always tell them apart."""
        held = level.select("lang", "phrase", "key").toArrow().combine_chunks()
        lang, phrase = (held.column(c).combine_chunks().cast(pa.large_string()) for c in ("lang", "phrase"))
        keys = held.column("key").to_numpy() if self.keys else _hash([word_hashes(phrase)], word_hashes(lang))
        if not self.keys:
            empty, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
            self.spaced = pc.binary_join_element_wise(phrase, empty, blank).cast(pa.large_binary()).take(pa.array(np.argsort(keys)))
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            return False
        self.langs.append(lang.take(pa.array(order)))
        self.phrases.append(phrase.take(pa.array(order)))
        self.keys.append(keys[order])
        return True

    def _words(self, part: Segment, lang: np.ndarray, langs: pa.Array) -> np.ndarray:
        """The number of each word of a segment, -1 for rare ones; equal hashes are confirmed by the bytes."""
        pair = lang.astype(np.int64) * len(part.kinds) + part.word
        size = len(langs) * len(part.kinds)
        if size <= TABLE:
            there = np.zeros(size, bool)
            there[pair] = True
            kinds, back = np.flatnonzero(there), pair
        else:
            kinds, back = np.unique(pair, return_inverse=True)
        of, word = kinds // max(1, len(part.kinds)), kinds % max(1, len(part.kinds))
        at = _found(self.keys[0], _hash([part.hashes()[word]], word_hashes(langs)[of]))
        some = np.flatnonzero(at >= 0)
        same = pc.and_(pc.equal(self.spaced.take(pa.array(at[some])), part.kinds.take(pa.array(word[some]))), pc.equal(self.langs[0].take(pa.array(at[some])), langs.cast(pa.large_string()).take(pa.array(of[some]))))
        at[some[~same.to_numpy(zero_copy_only=False)]] = -1
        if size <= TABLE:
            table = np.full(size, -1)
            table[kinds] = at
            return table[back]
        return at[back]

    def pairs(self, part: Segment, lang: np.ndarray, langs: pa.Array) -> np.ndarray:
        """For each place the pair of numbers of the two phrases of the last level that start there and a word later; -1 unless both are frequent."""
        ids = self._words(part, lang, langs)
        for keys in [*self.keys[1:], None]:
            pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), (ids[:-1] << 32) | ids[1:], -1)
            if keys is None:
                return pair
            ids = np.full(len(pair), -1)
            some = np.flatnonzero(pair >= 0)
            ids[some] = _found(keys, pair[some])
        return pair


class Sieve:
    """The frequent phrases of a level as bits: it lets all of them through, and a few others, which their counts then tell."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, U(len(bits) * 8 - 1)

    @classmethod
    def of(cls, level: DataFrame, words: int) -> Sieve:
        """From (lang, phrase). Executors set the bits; what reaches the driver is the sieve."""

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [p.split(" ") for p in batch.column(1).to_pylist()]
                h = _hash([word_hashes(pa.array([p[k] for p in parts], pa.string())) for k in range(words)], word_hashes(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

        place = F.col("h").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
        cells = level.select("lang", "phrase").mapInArrow(hashes, "h bigint").groupBy(F.shiftright(place, 5).cast("int").alias("cell"))
        held = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("b")).toArrow()
        bits = np.zeros(1 << (SIEVE_BITS - 5), np.uint32)
        bits[held.column("cell").to_numpy()] = held.column("b").to_numpy().astype(np.uint32)
        return cls(bits.view(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


class Segment:
    """The words of a stretch of a batch's bytes: numbered exactly, with their places and what joins them to the word before."""

    def __init__(self, data: np.ndarray, first: int, offsets: np.ndarray):
        kind = KIND[data]
        inside = kind == 0
        starts = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, first + len(data))] - first
        before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        before[starts] = False
        after[starts[starts > 0] - 1] = False
        self.start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.size = len(self.start)
        self.row = np.searchsorted(offsets, self.start + first, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.start] if self.size else self.start
        self.joined = np.r_[False, (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])][: self.size]
        # All words, each with one blank behind: a phrase is a stretch of these bytes.
        lengths = end - self.start
        self.offsets = np.r_[0, np.cumsum(lengths + 1)]
        self.text = np.full(self.offsets[-1], 32, np.uint8)
        self.text[np.arange(int(inside.sum())) + np.repeat(np.arange(self.size), lengths)] = LOWER[data[inside]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.size, [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.text)]).dictionary_encode()
        self.word, self.kinds = words.indices.to_numpy(), words.dictionary

    def hashes(self) -> np.ndarray:
        """Of each different word, as word_hashes gives them: without the blank behind."""
        data, offsets = text_bytes(self.kinds)
        sizes = np.diff(offsets) - 1
        kept = np.ones(len(data), bool)
        kept[offsets[1:] - 1] = False
        bounds = np.r_[0, np.cumsum(sizes)]
        return word_hashes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[kept]))]))

    def within(self, words: int) -> np.ndarray:
        """Whether so many words that start at each word lie in one piece."""
        ok = np.ones(max(self.size - words + 1, 0), bool)
        for k in range(1, words):
            ok &= self.joined[k : k + len(ok)]
        return ok

    def phrases(self, at: np.ndarray, words: int, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, count) of every different phrase of so many words among those that start at `at`, by language."""
        key, size = lang.astype(np.int64), int(lang.max(initial=0)) + 1
        for k in range(words):
            if size * len(self.kinds) >= 1 << 62:
                _, key = np.unique(key, return_inverse=True)
                size = int(key.max(initial=0)) + 1
            key, size = key * len(self.kinds) + self.word[at + k], size * len(self.kinds)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return at[first], counts

    def strings(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that start at `at`, joined by one blank."""
        start, length = self.offsets[at], self.offsets[at + words] - 1 - self.offsets[at]
        ends = np.r_[0, np.cumsum(length)]
        data = self.text[np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def segments(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[Segment, int]]:
    """The words of all rows; with each segment, the place of its first word that none before it has had as a phrase's last."""
    data, offsets = text_bytes(column)
    at, shared = 0, 0
    while at < len(data):
        to = min(at + shared + limit, len(data))
        while to < len(data):
            row = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[row] > at + shared:
                to = int(offsets[row])
                break
            last = min(int(offsets[row + 1]), to + limit)
            gap = np.flatnonzero(KIND[data[to:last]] > 0)
            to = to + int(gap[0]) if len(gap) else last
            if len(gap) or to in (len(data), int(offsets[row + 1])):
                break
        made = Segment(data[at:to], at, offsets)
        fresh = int(np.searchsorted(made.start, shared))
        yield made, fresh
        back = at + int(made.start[-(MOST - 1)]) if made.size >= MOST - 1 else at + (int(made.start[0]) if made.size else to - at)
        # Words of a row that has ended join nothing: the next segment starts behind them.
        row = int(np.searchsorted(offsets, to - 1, "right")) - 1
        at, shared = (to, 0) if offsets[row + 1] == to else (max(back, int(offsets[row])), to - max(back, int(offsets[row])))


def counts(texts: DataFrame, words: int, known: Sieve | None, limit: int = SEGMENT) -> DataFrame:
    """(lang, phrase, f) of all phrases of so many words whose two parts of one word less are in `known`.

    Of single words all are counted; and f beside a null phrase is the number of all words of the language.
    """
    held = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for batch in slices(batches, 1, limit):
            langs = batch.column(0).dictionary_encode()
            code, names = langs.indices.to_numpy(), langs.dictionary
            for part, fresh in segments(batch.column(1), limit):
                lang = code[part.row]
                ok = part.within(words)
                ok[: max(0, fresh - words + 1)] = False
                if frequent is not None and len(ok):
                    hashes, of = part.hashes()[part.word], word_hashes(names)[lang]
                    n = part.size - words + 2
                    there = frequent.has(_hash([hashes[k : k + n] for k in range(words - 1)], of[:n]))
                    ok &= there[:-1] & there[1:]
                at = np.flatnonzero(ok)
                first, f = part.phrases(at, words, lang[at])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[first])), part.strings(first, words), pa.array(f.astype(np.int64))], ["lang", "phrase", "f"])
                if words == 1:
                    of, n = np.unique(lang[fresh:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.nulls(len(of), pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "f"])

    return texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def pair_counts(texts: DataFrame, words: int, known: Numbered, least: int, limit: int = SEGMENT) -> DataFrame:
    """(lang, phrase, f, key) of the phrases of so many words that occur `least` times, counted as pairs of frequent phrases."""
    held = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for batch in slices(batches, 1, limit):
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            for part, fresh in segments(batch.column(1), limit):
                ok = part.within(words)
                ok[: max(0, fresh - words + 1)] = False
                if len(ok):
                    pair = frequent.pairs(part, code[part.row], langs.dictionary)[: len(ok)]
                    keys, f = np.unique(pair[ok & (pair >= 0)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f.astype(np.int64))], ["key", "f"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, phrases = held.value.langs[-1], held.value.phrases[-1]
        for batch in batches:
            pair = batch.column(0).to_numpy()
            first, rest = pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF)
            last = pc.replace_substring_regex(phrases.take(rest).cast(pa.string()), r"(?s)\A.* ", "")
            phrase = pc.binary_join_element_wise(phrases.take(first).cast(pa.string()), last, " ")
            yield pa.RecordBatch.from_arrays([langs.take(first).cast(pa.string()), phrase, batch.column(1), batch.column(0)], ["lang", "phrase", "f", "key"])

    counted = texts.mapInArrow(run, "key bigint, f bigint").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return counted.mapInArrow(named, f"{COUNTS}, key bigint")


def levels(docs: DataFrame, most: int = MOST, least: int = LEAST, exact: int = EXACT, limit: int = SEGMENT) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) with the number of all words, the frequent phrases (lang, phrase, f) of 1, 2, .. words)."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    ones = cut(counts(texts, 1, None, limit).filter(F.col("phrase").isNull() | (F.col("f") >= least)).withColumn("key", F.lit(None).cast("long")))
    made = [ones.filter("phrase is not null")]
    known = Numbered()
    for words in range(2, most + 1):
        if known is not None and made[-1].count() <= exact and known.take(made[-1]):
            made.append(cut(pair_counts(texts, words, known, least, limit)))
        else:
            known = None
            made.append(cut(counts(texts, words, Sieve.of(made[-1], words - 1), limit).filter(F.col("f") >= least)))
    return ones.filter("phrase is null").select("lang", F.col("f").alias("n")), [level.select("lang", "phrase", "f") for level in made]


def _part(words: Column | int, last: bool = False) -> Column:
    """Key (lang, first or last words) of a phrase."""
    words = F.lit(words) if isinstance(words, int) else words
    return F.struct("lang", F.call_function("substring_index", F.col("phrase"), F.lit(" "), -words if last else words).alias("phrase"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with a table that has each key once; keys that many rows share are taken out of the shuffle.

    What was looked up is written, since a hot join reads both sides several times and another one on top would read them all again.
    """
    return cut(hot_join(rows, cut(table.join(rows.groupBy(key).agg(F.count("*").alias("__size")), key)), key, "__size", total))


def scored(n: DataFrame, made: list[DataFrame]) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every frequent phrase of two words and more, by its lowest-scoring cut.

    floor(1000 a n / (l r)) in decimals of 38 digits, which holds for corpora of up to 10^17 words.
    """
    named = [level.select(F.struct("lang", "phrase").alias("key"), F.lit(k + 1).alias("words"), "f") for k, level in enumerate(made)]
    known = named[0]
    for level in named[1:]:
        known = known.union(level)
    known = known.select("key", "f")
    cuts = None
    for k, level in enumerate(made[1:], 2):
        rows = level.select("lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("k"))
        rows = rows.select("*", _part(F.col("k")).alias("first"), _part(F.lit(k) - F.col("k"), True).alias("rest"))
        cuts = rows if cuts is None else cuts.union(rows)
    cuts = cut(cuts)
    total = cuts.count()
    for part, f in (("first", "l"), ("rest", "r")):
        cuts = _looked_up(cuts, known.select(F.col("key").alias(part), F.col("f").alias(f)), part, total)
    cuts = _looked_up(cuts, n, "lang", total)
    big = lambda c: f"cast({c} as decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(({big('a')} * {big('n')} * cast(1000 as decimal(4,0))) div ({big('l')} * {big('r')}) as bigint)"))
    best = cuts.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    return best.select("lang", "phrase", "words", "b.a", "b.l", "b.r", "b.n", "b.score")


def uncovered(rows: DataFrame, made: list[DataFrame], cover: int = COVER) -> DataFrame:
    """Without phrases that stand within a frequent longer one which has `cover` hundredths of their occurrences.

    Occurrences only get fewer as a phrase grows, so it is enough to look at the phrases of one word more.
    """
    longer = None
    for k, level in enumerate(made[2:], 2):
        for last in (False, True):
            parts = level.select(_part(k, last).alias("key"), "f")
            longer = parts if longer is None else longer.union(parts)
    if longer is None:
        return rows
    longer = longer.groupBy("key").agg(F.max("f").alias("__f")).select("key.lang", "key.phrase", "__f")
    return rows.join(longer, ["lang", "phrase"], "left").filter(F.col("__f").isNull() | (100 * F.col("__f") < cover * F.col("a"))).drop("__f")


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language with their rank: parts of a language are cut to as many first, then their union."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(rows.sparkSession))))
    for by in (["lang", "__part"], ["lang"]):
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return few.drop("__part")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, cover: int = COVER, exact: int = EXACT, limit: int = SEGMENT) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: the best phrases of 2 to `most` words of each language of (lang, text).

    a, l and r are how often the phrase and the two parts of its lowest-scoring cut (the first of equals) occur within pieces,
    overlaps and repeated rows included; n is the number of the language's words; null languages are one of their own. Null
    and empty texts have no words; empty tables, and tables without a frequent phrase, give no rows; other columns are ignored.
    """
    n, made = levels(docs, most, least, exact, limit)
    return best(uncovered(scored(n, made), made, cover), top).select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
