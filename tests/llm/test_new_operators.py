"""Resampling, collocations and mixing against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkgrid.llm import collocations, decontaminate, mixing, ngram_join, quality, resampling

DOCS = "doc_id bigint, text string, lang string, source string, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sample(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["der", "Die", "and", "é", "ßa", "x1", "naïve", "cat", "sat", "the"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "-"]) for _ in range(rng.randint(0, 90)))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "é"]), "own"))
    rows += [(100, None, "en", "a", "own"), (101, "", "en", "a", "own"), (102, " \t", None, None, "own"), (103, "the cat sat " * 3000, "en", "b", "own")]
    rows += [(104, "w" * 70 + " the " + "w" * 64 + "\x00" + "w" * 63, "en", "c", "own"), (None, rows[0][1], "en", "a", "own")]
    return rows + [rows[1]] * 40 + [rows[5]] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS)


def plain_features(text):
    words = WORD.findall(lower(text))
    return words, Counter(" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1))


def plain_resample(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    made = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in made:
        for k, n in f.items():
            s[bucket(k)] += n
    for text in target:
        for k, n in plain_features(text)[1].items():
            t[bucket(k)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, words, f in made:
        weight = sum(n * gain(bucket(k)) for k, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return out


def test_resample_against_plain_version(spark, docs):
    target = ["the cat sat. the naïve cat", None, "", "and the cat sat"]
    found = resampling.resample(docs, spark.createDataFrame([(1, t) for t in target], "item_id int, text string"), percent=60)
    wanted = plain_resample([(r[0], r[1]) for r in sample()], target, 60, 20)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, wanted), key=key)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_features_across_blocks(monkeypatch):
    """A text of many blocks, with words on both sides of every cut and words longer than zlib's threshold."""
    monkeypatch.setattr("inkgrid.llm.words.BLOCK", 50)
    rng = random.Random(1)
    texts = [" ".join("ab"[rng.randint(0, 1)] * rng.choice([1, 2, 5, 63, 64, 65, 130]) for _ in range(200)), None, "", "a b", "a", "..a..b.c", "é" * 100]
    keys, counts, words = resampling.counted(pa.array(texts, pa.string()))
    got = Counter(dict(zip(keys.tolist(), counts.tolist())))
    wanted = Counter()
    for row, text in enumerate(texts):
        for f, n in plain_features(text)[1].items():
            wanted[row * 10000 + zlib.crc32(f.encode()) % 10000] += n
    assert got == wanted and words.tolist() == [len(plain_features(t)[0]) for t in texts]


def test_resample_edges(spark, docs, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, docs).count() == 0
    nothing = resampling.resample(docs, none)
    assert nothing.count() == docs.count() and nothing.filter("rank is null").count() < docs.count()
    kept = str(tmp_path / "matrix")
    resampling.resample(docs, docs, keep=kept)
    held = spark.read.parquet(kept)
    sums = resampling.column_sums(held)
    assert sums.sum() == sum(sum(plain_features(r[1])[1].values()) for r in sample())
    few = docs.filter("doc_id < 100").dropDuplicates(["doc_id"])
    drawn = resampling.drawn_docs(few, docs, percent=10)
    able = sum(len(WORD.findall(lower(r['text']))) >= 20 for r in few.collect())
    assert sorted(drawn.columns) == sorted(few.columns) and drawn.count() == 10 * able // 100
    assert np.array_equal(resampling.gains(sums, sums), np.zeros(10000))


def plain_phrases(rows, least, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                for k in range(len(words) - m + 1):
                    f[lang][tuple(words[k : k + m])] += 1
    out = []
    for lang, counted in f.items():
        frequent = {p: a for p, a in counted.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in frequent.items():
            score, k = min((1000 * a * n[lang] // (counted[p[:k]] * counted[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            if not inside:
                rows_.append((lang, " ".join(p), a, counted[p[:k]], counted[p[k:]], n[lang], score))
        rows_.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows_[:top])]
    return sorted(out)


@pytest.mark.parametrize("exact, limit, table", [(1 << 21, 1 << 20, 1 << 24), (1 << 21, 40, 0), (0, 40, 0), (12, 1 << 20, 0)])
def test_collocations_against_plain_version(docs, exact, limit, table, monkeypatch):
    """With all levels numbered, with sieves, and with sieves from the second level on; in one segment and in segments of forty bytes."""
    monkeypatch.setattr(collocations, "SIEVE_BITS", 12)
    monkeypatch.setattr(collocations, "TABLE", table)
    found = collocations.collocations(docs, least=12, top=30, exact=exact, limit=limit).drop("words")
    assert sorted(map(tuple, found.collect())) == plain_phrases([(r[1], r[2]) for r in sample()], 12, 30)


def test_collocations_of_nothing(spark, docs):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**15
    one = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big)], collocations.COUNTS)
    two = spark.createDataFrame([("en", "a b", big)], collocations.COUNTS)
    n = spark.createDataFrame([("en", 7 * big)], "lang string, n bigint")
    assert collocations.scored(n, [one, two]).first()["score"] == 1000 * big * 7 * big // (6 * big * big)


def test_mix_keeps_to_targets(spark, docs):
    rows = mixing.mix(docs, block=8, shard_slots=32).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source, wanted = defaultdict(int), Counter()
    for r in sample():
        by_source[r[3]] += size(r[1])
    for r in sample():
        wanted[(r[0], size(r[1]), by_source[r[3]])] += 1
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in rows) == wanted
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    aim = dict(zip(names, mixing.targets([by_source[s] for s in names])))
    for s in names:
        of = [r for r in rows if r["source_size"] == by_source[s]]
        assert {r["target"] for r in of} == {aim[s]}
        assert abs(sum(r["taken"] for r in of) - aim[s]) < 16
    assert Counter(rows) == Counter(mixing.mix(docs.repartition(5), block=8, shard_slots=32).collect())


def test_targets():
    assert mixing.targets([10, 10, 10]) == [5.0, 10.0, 15.0]
    assert mixing.targets([1, 100, 1]) == [3.0, 96.0, 3.0]
    assert mixing.targets([0, 6, 0]) == [0.0, 6.0, 0.0] and mixing.targets([]) == []


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 100, 1009):
        for key in (1, 99):
            found = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(found.tolist()) == list(range(n))
    sizes = np.repeat([5, 9], [5, 9])
    found = mixing.permuted(np.r_[np.arange(5), np.arange(9)], sizes, np.ones(14, np.uint64))
    assert sorted(found[:5].tolist()) == list(range(5)) and sorted(found[5:].tolist()) == list(range(9))


def test_slots_follow_the_plan(spark):
    made = mixing.Plan(["a", "b", None], [1000, 40, 7], block=8)
    rows = mixing.slots(spark, made, shard_slots=16).collect()
    assert Counter(r["source_no"] for r in rows) == Counter({k: n for k, n in enumerate(made.slots) if n})
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(min(16, made.total - 16 * k))) for k, s in by_shard.items())
    turns = defaultdict(list)
    for r in rows:
        turns[(r["source_no"], r["turn"])].append(r["block"])
    assert all(len(b) == len(set(b)) and max(b) < made.blocks[k[0]] for k, b in turns.items())
    draws = mixing.draws(spark, made, shard_slots=16).groupBy("shard").sum("n").collect()
    assert sorted(r[1] for r in draws) == sorted([16] * (made.total // 16) + ([made.total % 16] if made.total % 16 else []))


def test_mixed_parts_hold_the_words(docs):
    """Each slot's parts are its block, and the words of all slots are those that mix counts."""
    parts = mixing.mixed_parts(docs, block=8, shard_slots=32).collect()
    blocks = defaultdict(list)
    for p in parts:
        blocks[(p["shard"], p["slot"])].append(p)
    for rows in blocks.values():
        rows.sort(key=lambda p: p["place"])
        at = 0
        for p in rows:
            assert p["place"] == at
            at += len(p["text"].split(" "))
        assert at <= 8 and len({(p["source"], p["block"]) for p in rows}) == 1
    found = Counter()
    for p in parts:
        found[p["doc_id"]] += len(p["text"].split(" "))
    taken = Counter()
    for r in mixing.mix(docs, block=8, shard_slots=32).collect():
        taken[r["doc_id"]] += r["taken"]
    assert +found == +taken
    giant = " ".join(p["text"] for p in sorted((p for p in parts if p["doc_id"] == 103 and p["turn"] == 0), key=lambda p: p["block"]))
    assert set(giant.split(" ")) == {"the", "cat", "sat"}


def test_mix_of_nothing(spark):
    empty = mixing.mix(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "source_size", "target", "taken"]
    bare = mixing.mix(spark.createDataFrame([(1, None, None, "a", ""), (2, " ", None, None, "")], DOCS)).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in bare} == {(0, 0, 0.0)}


def test_many_sources_are_refused(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs)


def test_callers_columns_clash_with_nothing(spark):
    """Names that the operators use inside come back with the caller's values and types."""
    texts = ["one two three four five six seven"] * 2 + ["the quick brown fox jumps over the lazy dog again", None]
    own = ["__id", "__doc", "__row", "__gid", "__score", "__predicted", "__own0", "__piece", "gid", "id", "row", "node"]
    rows = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in own]) for k, t in enumerate(texts)], f"doc_id bigint, text string, {', '.join(f'`{c}` string' for c in own)}")
    items = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for kept, ids in (
        (ngram_join.one_of_each(rows), {0, 2, 3}),
        (ngram_join.one_of_each(rows.union(rows)), {0, 2, 3}),
        (decontaminate.drop_leaks(rows, items), {0, 1, 3}),
        (decontaminate.drop_leaks(rows, items, broadcast_chars=0), {0, 1, 3}),
        (quality.keep_good(rows, labels), {0, 1, 2, 3}),
    ):
        found = kept.collect()
        assert kept.columns == rows.columns and sorted(r["doc_id"] for r in found) == sorted(ids)
        assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in own)


def test_groups_within_groups_go(spark):
    """Of nested groups only the largest is compared, and every pair of members is still in some group."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(999)}" for _ in range(60)]
    made = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1])):
            words[rng.randrange(60)] = f"x{k}"
        made.append((k, " ".join(words), None, None, None))
    docs = spark.createDataFrame(made, DOCS)
    shingles = {i: frozenset(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for i, t, *_ in made}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(docs).collect()}
    for i, s in shingles.items():
        texts = {made[j][1] for j, o in shingles.items() if made[j][1] != made[i][1] and len(s & o) >= 0.8 * len(s | o)}
        assert got[i] == len(texts)
