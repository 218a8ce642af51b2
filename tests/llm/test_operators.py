"""Every operator against a plain version of itself on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkgrid.llm import common, decontaminate, fingerprints, license_scan, ngram_join, quality, sentencepiece_codec, sharding, suffix_dedup, url_filter, warc
from inkgrid.llm.common import numbered
from inkgrid.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def texts(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    shared = words(rng, 60)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, base[1].replace(" ", "  ", 1) + " tail"), (23, base[2] + " " + shared), (24, shared + " " + base[3])]
    rows += [(25, None), (26, ""), (27, "one two"), (28, "one two"), (29, "x" * 700), (30, words(rng, 5000)), (31, "é" * 150), (32, "é" * 150), (33, " \n\t ")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts()], DOCS)
    return made.withColumn("score", F.lit("own")).withColumn("gid", F.lit(-1)).withColumn("spans", F.lit("own"))


@pytest.fixture(scope="module")
def doubled(spark):
    """Ids that repeat, with the same text and with others, and null ids."""
    rows = texts()
    rows += [(0, rows[0][1]), (1, rows[2][1]), (None, rows[3][1]), (None, "short"), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = [x for x in re.split("[\x00-\x20]+", text or "") if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    kinds = {}
    for i, t in rows:
        kinds.setdefault(t or "", []).append(i)
    keys = list(kinds)
    sets = [shingle_set(t) for t in keys]
    links = {k: {j for j in range(len(keys)) if j != k and sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])} for k in range(len(keys))}
    out, seen = {}, {}
    for k in links:
        if k in seen:
            continue
        group, wave = {k}, {k}
        while wave:
            wave = {j for m in wave for j in links[m]} - group
            group |= wave
        ids = [i for m in group for i in kinds[keys[m]] if i is not None]
        for m in group:
            seen[m] = min(ids) if ids else None
    for k, t in enumerate(keys):
        out[t] = (seen[k], len(links[k]), len(kinds[t]))
    return out


def test_join_is_brute_force(spark, docs):
    want = brute_groups(texts())
    got = ngram_join.near_duplicates(docs).collect()
    by_id = dict(texts())
    assert len(got) == len(by_id)
    for r in got:
        assert (r["class_id"], r["n_links"], r["n_copies"]) == want[by_id[r["doc_id"]] or ""], r


def test_join_with_odd_ids_and_nothing(spark, doubled):
    assert ngram_join.near_duplicates(doubled).count() == doubled.count()
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(doubled)
    assert kept.columns == doubled.columns
    roots = brute_groups([(t or "", t) for _, t in ((r["doc_id"], r["text"]) for r in doubled.collect())])
    assert kept.count() == len({root for root, _, _ in roots.values()})
    plain = [(k, t) for k, (_, t) in enumerate(texts())]
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(spark.createDataFrame([(i, t, None, None, None) for i, t in plain], DOCS)).collect()) == sorted({g for g, _, _ in brute_groups(plain).values()})


def test_join_cuts_large_groups_into_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 4)
    rng = random.Random(8)
    base = words(rng, 100).split()
    rows = []
    for k in range(30):
        w = list(base)
        w[rng.randrange(100)] = f"new{k}"
        rows.append((k, " ".join(w)))
    want = brute_groups(rows)
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    for r in ngram_join.near_duplicates(made).collect():
        assert (r["class_id"], r["n_links"], r["n_copies"]) == want[rows[r["doc_id"]][1]]


def test_forest_stops_where_its_target_is_met():
    """The stop hangs on the text: no partner of a set of n shingles can have less than least_similarity(n)."""
    for n in range(1, 60):
        values = [c / (n + m - c) for m in range(1, 80) for c in range(1, min(n, m) + 1) if (n, m) != (c, c)]
        least = min([v for v in values if v >= 0.8 - 1e-12], default=1.0)
        assert abs(ngram_join.least_similarity(n) - least) < 1e-12, n
        depth = ngram_join.stop_depth(n)
        found = lambda d: 1 - (1 - least**d) ** ngram_join.TREES  # noqa: B023, E731
        assert found(depth) >= ngram_join.TARGET and (depth == ngram_join.LABEL or found(depth + 1) < ngram_join.TARGET)
    assert [ngram_join.stop_depth(n) for n in (3, 7, 6, 500)] == [8, 7, 6, 5]


def test_tries_shorten_prefixes_down_to_the_stop():
    """Entries that stop at 8 meet at a full label only, those that stop at 5 meet at 5; trees do not mix."""
    label = np.array([[1] * 8, [1] * 8, [1, 1, 1, 1, 1, 1, 1, 2], [1, 1, 1, 1, 1, 2, 2, 2], [1, 1, 1, 1, 3, 3, 3, 3], [1] * 8, [9] * 8], np.uint16)
    tree, stop = np.array([0, 0, 0, 0, 0, 1, 1], np.int32), np.array([8, 8, 5, 5, 5, 5, 5], np.int32)
    pad = np.zeros((1, 8), np.uint16)
    label = np.concatenate([pad, label, pad + 7])
    tree, stop = np.r_[-1, tree, 9].astype(np.int32), np.r_[5, stop, 5].astype(np.int32)
    groups = {}
    for rows, gid in ngram_join.shared_prefixes(tree, label, stop):
        for row, g in zip(rows.tolist(), gid.tolist()):
            groups.setdefault(g, []).append(row - 1)
    assert sorted(g for g in groups.values() if len(g) > 1) == [[0, 1], [2, 3]]


@pytest.mark.parametrize("n", [4, 6, 9, 40, 300])
def test_forest_finds_pairs_at_the_threshold(spark, n):
    """Pairs of sets of about n shingles, of the least similarity that is a link, and as many just below it."""
    rng, rows = random.Random(n), []
    size = lambda k: [f"w{n}x{k}x{rng.randrange(10**9)}" for _ in range(n + 4)]
    for k in range(60):
        w = size(k)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, *(f"e{k}x{j}" for j in range(n // 4 + k % 2))]))]
    want = brute_groups(rows)
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(made).collect()}
    assert got == {i: want[t][:2] for i, t in rows} and sum(v[1] for v in got.values()) >= 2 * 30


def test_join_of_texts_with_one_shingle_set(spark):
    """Texts that differ in white space only are different texts of one set: each is a link of the others."""
    rng = random.Random(21)
    base = words(rng, 40)
    rows = [(k, base.replace(" ", " " * (k + 1), 1)) for k in range(4)] + [(9, base + " end")]
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert {(r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(made).collect()} == {(0, 4, 1)}


def test_one_of_each_is_the_same_in_every_run(spark):
    rows = [(1, "a b c d e f", "x", "s", 1), (1, "a b c d e f", None, "s", 2), (1, "a b c d e f", "b", None, 3)]
    kept = {tuple(r) for part in (1, 2, 5) for order in (rows, rows[::-1]) for r in ngram_join.one_of_each(spark.createDataFrame(order, DOCS).repartition(part)).collect()}
    assert len(kept) == 1


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rows = spark.createDataFrame([(k % 4 if k % 2 else 7, k) for k in range(40)] + [(None, -1)], "k int, v int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    got = sorted(tuple(r) for r in common.hot_join(rows, table, "k", "n", 41).collect())
    assert got == sorted(tuple(r) for r in rows.join(table.drop("n"), "k").collect()) and len(got) == 40


def test_no_folder_is_made_up():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(60)] + [(7, 7), (300, 300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_codec_gives_the_librarys_ids(spark, docs):
    codec = sentencepiece_codec.Codec()
    rng = random.Random(2)
    parts = ["a", " ", "  ", "the", "\n", "\t", "é", "①", "▁", "x▁", "'s", "123", "...", "　"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert codec.encode(text) == codec.model.encode(text), text
    got = {r["doc_id"]: r for r in sentencepiece_codec.digests(docs).collect()}
    for i, t in texts():
        assert got[i]["n_pieces"] == len(codec.model.encode(t or "")) and got[i]["round_trip"]
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).select("text", "decoded").collect()
    assert all(r["decoded"] == r["text"] for r in rows)
    assert sentencepiece_codec.digests(empty(spark)).count() == 0


@pytest.mark.parametrize("segment", [1, 7, 60])
def test_segments_of_giant_texts_join_to_the_librarys_ids(spark, segment):
    """Texts in segments dealt over tasks: blanks in rows, no blanks, other signs, repeated rows, null ids, the blank sign itself."""
    rng = random.Random(segment)
    parts = ["a", " ", "  ", "the", "\n", "é", "①", "'s", "123", "...", "word", "　"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (200, "x" * 300), (201, "▁ " * 40), (202, None), (203, " " * 50), (204, " lead and trail "), (204, " lead and trail ")]
    model = sentencepiece_codec.Codec().model
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["round_trip"], r["ids_sha256"]) for r in sentencepiece_codec.encoded(made, segment=segment).collect())
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "")
        want[i, tuple(ids), model.decode(ids), model.decode(ids) == (t or ""), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()] += 1
    assert got == want


def test_a_text_of_megabytes_is_one_row(spark):
    rng = random.Random(3)
    text = words(rng, 250_000)
    row = sentencepiece_codec.encoded(spark.createDataFrame([(1, text, None, None, None)], DOCS), segment=1 << 18).first()
    assert row["ids"] == sentencepiece_codec.Codec().model.encode(text) and row["round_trip"]


def labelled(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        t = words(rng, 80).capitalize() + "." if good else " ".join(rng.choice(["###", "$$$", "BUY!!", "%%%"]) + rng.choice("XYZ") * 3 for _ in range(80))
        rows.append((k, t, None, None, None))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(spark, docs):
    d, labels = labelled(spark)
    got = quality.judge(d, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = spark.createDataFrame([], labels.schema)
    assert quality.judge(docs, none).select("score").distinct().collect()[0][0] == 0.5
    assert quality.judge(empty(spark), labels).count() == 0


def test_quality_leaves_callers_columns_alone(spark):
    """keep_good returns the caller's score and predicted, values and types, and clean documents of any kind of column."""
    d, labels = labelled(spark, 300)
    own = d.withColumns({"score": F.concat(F.lit("s"), F.col("doc_id")), "predicted": F.array("doc_id")})
    kept = quality.keep_good(own, labels)
    assert kept.schema == own.schema and kept.count() > 150
    assert kept.filter("score <> concat('s', doc_id) or predicted[0] <> doc_id").count() == 0


def test_quality_is_the_difference_by_hand(spark):
    """Scores are the calibrated differences of sizes that zstandard gives for the pieces; very long, empty and null texts too."""
    import zstandard

    d, labels = labelled(spark, 300)
    model = quality.fit(d, labels)
    rows = [(1, "x " * 400_000), (2, ""), (3, None), (4, d.first()["text"]), (4, d.first()["text"])]
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    packs = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        good, bad = (sum(len(p.compress(raw[k : k + 512])) for k in range(0, max(1, len(raw)), 512)) for p in packs)
        want.append((i, round(1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * (bad - good) / max(1, len(raw))))), 6)))
    got = quality.score(made, model).select("doc_id", "score", "predicted").collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == sorted(want)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_without_a_model_rejects_nothing(spark, docs):
    _, labels = labelled(spark, 90)
    for some in (labels.limit(0), labels.filter("quality = 0"), labels.limit(3), labels.withColumn("doc_id", F.lit(-5))):
        assert quality.keep_good(docs, some).count() == docs.count()


def test_quality_learns_from_long_texts(spark):
    d, labels = labelled(spark, 90)
    long = d.withColumn("text", F.expr("repeat(text || ' ', 100)"))
    assert long.agg(F.min(F.char_length("text"))).first()[0] > quality.SAMPLE_CHARS
    assert quality.fit(long, labels).weights
    kept = {r["doc_id"] for r in quality.keep_good(long, labels).collect()}
    good = {k for k in range(90) if k % 3}
    assert kept <= good and len(kept) >= 0.95 * len(good)


def test_quality_samples_all_of_a_text(spark):
    n, piece = quality.SAMPLE_CHARS, quality.PIECE
    rows = [("s" * n,), ("a" * piece + "b" * (3 * n) + "é" * piece,)]
    short, long = [r[0] for r in spark.createDataFrame(rows, "text string").coalesce(1).select(quality.sampled(F.col("text"))).collect()]
    assert short == rows[0][0] and long[:piece] == "a" * piece and long[-piece:] == "é" * piece and n - piece < len(long) <= n


def test_quality_replaces_labels_without_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PER_CLASS", 40)
    d, labels = labelled(spark, 300)
    lost = spark.createDataFrame([(k, q, 0) for k in range(1000, 9000) for q in (k % 2,)], labels.schema)
    assert quality.fit(d, labels.unionByName(lost)) == quality.fit(d, labels)


def test_licenses_against_plain_containment(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for k, (name, _, text) in enumerate(license_scan.TEMPLATES):
        rows.append((k, f"{words(rng, 30)}\n{text}\n{words(rng, 3000 if k == 1 else 30)}", None, None, None))
        want.add((k, name))
    rows += [(50, None, None, None, None), (51, "", None, None, None), (52, words(rng, 50), None, None, None), (53, "Released under the MIT License.", None, None, None)]
    got = {(r["doc_id"], r["template"]) for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert want <= got and (53, "mit-line") in got
    assert {d for d, _ in got} == set(range(len(license_scan.TEMPLATES))) | {53}
    assert license_scan.collision_probability(0.8) > 0.999
    assert license_scan.scan(empty(spark)).count() == 0


def brute_licenses(text, templates):
    """template: best containment in any stretch of words as long as the template and a little more, for templates without marks."""
    split = lambda t: "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in t).split()
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    own, out = grams(split(text)), {}
    for name, _, t in templates:
        want = grams(split(t))
        reach = len(want) + len(want) // license_scan.SLACK + 5
        best = max((len(set(own[k : k + reach]) & set(want)) / len(set(want)) for k in range(len(own))), default=0.0)
        if best >= license_scan.CONTAINED:
            out[name] = best
    return out


def test_licenses_against_brute_containment(spark):
    """Damaged, repeated and interleaved notices of invented templates, the templates from a table."""
    rng = random.Random(14)
    templates = [(f"t{k}", f"L{k}", words(rng, n)) for k, n in enumerate((5, 9, 25, 60, 200))]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(templates)[2].split()
            for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
                w[rng.randrange(len(w))] = "changed"
            cut = rng.choice((len(w), len(w), len(w) * 9 // 10, len(w) // 2))
            parts += [" ".join(w[:cut]), words(rng, rng.choice((0, 1, 30)))]
        rows.append((k, " ".join(parts), None, None, None))
    table = spark.createDataFrame(templates, "template string, license string, text string")
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, DOCS), table).collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = round(r["containment"], 9)
    want = {k: {n: round(v, 9) for n, v in found.items()} for k, t, *_ in rows if (found := brute_licenses(t, templates))}
    pairs = [(got[k][n], v) for k, found in want.items() for n, v in found.items()]
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()} and len(pairs) > 50
    # Places are separate, so a stretch over two damaged copies can hold more than either place.
    assert all(license_scan.CONTAINED <= a <= b for a, b in pairs) and sum(a == b for a, b in pairs) > 0.95 * len(pairs)
    assert license_scan.scan(spark.createDataFrame(rows, DOCS), table.limit(0)).count() == 0


def test_refuses_more_templates_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "TEMPLATE_CHARS", 10)
    with pytest.raises(ValueError, match="characters"):
        license_scan.from_table(spark.createDataFrame([("a", "b", "x" * 11)], "template string, license string, text string"))


@pytest.mark.parametrize("times", [1, 2, 3, 6])
def test_adjacent_notices_are_separate_matches(spark, times):
    text = dict((t[0], t[2]) for t in license_scan.TEMPLATES)["mit-grant"]
    made = spark.createDataFrame([(1, "\n".join([text] * times), None, None, None)], DOCS)
    row = license_scan.scan(made).filter("template = 'mit-grant'").first()
    assert row["n_matches"] == times and (row["first_word"], row["last_word"]) == (0, len(re.findall(r"[A-Za-z0-9]+", text)) - 1)


def test_scan_of_a_text_of_many_blocks(spark):
    """A text of over 256 KiB is hashed in blocks cut between words: a notice over a cut is found."""
    rng = random.Random(15)
    notice = license_scan.NOTICES[1][2]
    at = (1 << 18) - 60
    long = ("word " * (at // 5 + 1))[:at] + " " + notice + " " + "x" * 300_000 + " " + notice + " " + words(rng, 60_000)
    row = license_scan.scan(spark.createDataFrame([(1, long, None, None, None)], DOCS)).filter("template = 'apache-2.0-notice'").first()
    assert row["n_matches"] == 2


def test_related_licenses_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {} Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    whole = {license_: text for name, license_, text in license_scan.TEMPLATES if name.endswith("-text")}
    rows = {
        "GPL-2.0-or-later": gnu.format("General", "2"),
        "GPL-3.0-or-later": gnu.format("General", "3"),
        "LGPL-2.1-or-later": gnu.format("Lesser General", "2.1"),
        "AGPL-3.0-or-later": gnu.format("Affero General", "3"),
        "GPL": gnu.format("General", "4"),
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 and so on",
        **{k: whole[k] for k in ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MIT", "Zlib", "Unlicense")},
    }
    made = spark.createDataFrame([(k, f"start of it\n{t}\nend of it", None, None, None) for k, t in enumerate(rows.values())], DOCS)
    found = {}
    for r in license_scan.scan(made).collect():
        found.setdefault(list(rows)[r["doc_id"]], set()).add(r["license"])
    assert found == {k: {k} for k in rows}
    both = [(1, whole["GPL-3.0"], None, None, None), (2, whole["LGPL-2.1"], None, None, None), (3, whole["MIT"] + whole["BSD-3-Clause"], None, None, None), (4, gnu.format("Foo General", "3"), None, None, None)]
    found = {}
    for r in license_scan.scan(spark.createDataFrame(both, DOCS)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert found == {1: {"GPL-3.0"}, 2: {"LGPL-2.1"}, 3: {"MIT", "BSD-3-Clause"}}


def test_fingerprints(spark, docs, doubled):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    rows = sorted(((i, t or "") for i, t in texts()), reverse=True)
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for likeness, a, b in ((r["near_edited"], t, edited), (r["near_next"], t, other)):
            a, b = (frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := x.split()) else frozenset() for x in (a, b))
            assert abs(likeness - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2, (i, likeness)
    assert got[0]["fingerprint"] == got[20]["fingerprint"] and got[25]["fingerprint"] == ""
    assert fingerprints.fingerprint_edits(doubled).count() == doubled.count()
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0
    assert fingerprints.fingerprint_edits(docs.limit(1)).select("near_next").first()[0] == 1.0


def test_leaks_against_plain_distance(spark):
    rng = random.Random(6)
    item = "".join(rng.choice("abcdef ") for _ in range(120))
    near = item[:30] + "Z" + item[31:80] + item[83:]
    far = "".join(c if k % 6 else "Q" for k, c in enumerate(item))
    pad = words(rng, 40)
    rows = [(0, pad + item + pad), (1, pad + near + pad), (2, pad + far + pad), (3, None), (4, ""), (5, words(rng, 4000) + near), (5, words(rng, 10) + near)]
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    items = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, item)], "item_id bigint, text string")
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(made, items).collect())
    assert got == Counter({(0, 9, 0): 1, (0, 12, 0): 1, (1, 9, 4): 1, (1, 12, 4): 1, (5, 9, 4): 2, (5, 12, 4): 2})
    kept = decontaminate.drop_leaks(made, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == made.columns
    assert decontaminate.leaks(made, items.limit(0)).count() == 0 and decontaminate.leaks(empty(spark), items).count() == 0


def edit_table(item, text):
    """Least edit distance of the item to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        old, row = row, [i + 1]
        for j, d in enumerate(text):
            row.append(min(old[j] + (c != d), old[j + 1] + 1, row[j] + 1))
    return min(row)


@pytest.mark.parametrize("limit", [None, 0])
def test_leaks_are_those_of_the_edit_table(spark, limit):
    """Items of many lengths with random edits, in texts of other characters too; both ways of searching."""
    rng = random.Random(16)
    letters = "abcde é"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, draw(n)) for k, n in enumerate((1, 3, 9, 15, 19, 20, 25, 39, 40, 41, 60, 90, 130))] + [(50, None), (51, "")]
    rows = []
    for k in range(80):
        t = list(rng.choice(items[3:13])[1])
        for _ in range(rng.randint(0, 1 + len(t) // 15)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = [rng.choice(letters + "Z")] * rng.randint(0, 1)
        rows.append((k, draw(rng.randint(0, 30)) + "".join(t) + draw(rng.randint(0, 30)), None, None, None))
    rows += [(90, None, None, None, None), (91, "", None, None, None), (91, rows[0][1], None, None, None)]
    want = Counter((i, j, d) for i, t, *_ in rows for j, item in items if t and item and (d := edit_table(item, t)) <= decontaminate.budget(len(item)))
    made, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.leaks(made, table, limit).collect()
    assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == want and len(want) > 40
    texts_of, by_item = {(i, t) for i, t, *_ in rows}, dict(items)
    for r in got:
        assert any(edit_table(by_item[r["item_id"]], t[r["first_char"] : r["last_char"] + 1]) == r["distance"] for i, t in texts_of if i == r["doc_id"] and t)
    kept = decontaminate.drop_leaks(made, table, limit)
    gone = {t for i, t, *_ in rows if any(i == k[0] for k in want) and t}
    assert kept.columns == made.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t, *_ in rows if t not in gone)


def test_both_searches_give_the_same_rows(spark):
    rng = random.Random(17)
    item = words(rng, 60)
    rows = [(k, words(rng, 20) + item[k : len(item) - k] + words(rng, 20) + item, None, None, None) for k in range(12)] * 2
    items = spark.createDataFrame([(1, item), (2, item), (3, item[:40]), (1, item)], "item_id bigint, text string")
    made = spark.createDataFrame(rows, DOCS)
    one, two = (Counter(map(tuple, decontaminate.leaks(made, items, limit).collect())) for limit in (None, 0))
    assert one == two and len(one) == 36


PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    page = '<html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- x --><p>One <b>two</b><br>three</p><a href="/x">link</a></body></html>'
    made = spark.createDataFrame([(1, "http://a.example/", page), (2, None, None), (3, "http://b.example/\nx", ""), (1, "http://a.example/", page)], PAGES)
    rows = warc.derive(warc.responses(made))
    got = rows.collect()
    assert Counter(r["record_type"] for r in got) == Counter(metadata=4, conversion=4)
    one = {r["record_type"]: r for r in got if r["page_id"] == 1}
    assert one["conversion"]["block"] == "A & B\nOne two\nthree\nlink"
    assert one["metadata"]["refers_to"] == one["conversion"]["refers_to"] and one["metadata"]["record_id"] != one["conversion"]["record_id"]
    assert one["conversion"]["source_payload_digest"] == warc.digest(page.encode()) and one["conversion"]["content_length"] == len("A & B\nOne two\nthree\nlink")
    assert "outlink: /x" in one["metadata"]["block"] and "title: A & B" in one["metadata"]["block"]
    warc.write(rows, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == 8 and all(r["complete"] for r in back)
    assert Counter(r["headers"]["WARC-Record-ID"] for r in back) == Counter(r["record_id"] for r in got)
    assert warc.derive(warc.responses(made.limit(0))).count() == 0


def parse_warc(data):
    """An independent reader of WARC/1.1 bytes: (headers, block) by Content-Length alone."""
    at, out = 0, []
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        assert len(block) == size and data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        out.append((headers, block))
        at = end + 8 + size
    return out


def test_warc_files_are_warc(spark, tmp_path):
    """Pages with NUL, with version lines in the text, ending in line ends, repeated: whole records, read by any reader and by ours."""
    pages = ["<p>a\x00b</p>", "<p>x</p><pre>WARC/1.1\r\n\r\nWARC/1.1\r\n</pre>", "", "é<br>" * 5000, None, "<p>x\r\n\r\n"]
    made = spark.createDataFrame([(k % 5, f"http://h/{k % 5}", p) for k, p in enumerate(pages * 2)], PAGES)
    rows = warc.derive(warc.responses(made))
    got = rows.collect()
    assert len(got) == 4 * len(pages) and len({r["record_id"] for r in got}) == len(got)
    warc.write(rows, str(tmp_path / "w"))
    plain = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in parse_warc(f.read_bytes())]
    assert Counter((h["WARC-Record-ID"], h["WARC-Refers-To"], b) for h, b in plain) == Counter((r["record_id"], r["refers_to"], r["block"].encode()) for r in got)
    assert all(warc.digest(b) == h["WARC-Block-Digest"] for h, b in plain)
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert Counter((r["headers"]["WARC-Record-ID"], bytes(r["block"])) for r in back) == Counter((h["WARC-Record-ID"], b) for h, b in plain) and all(r["complete"] for r in back)


def test_warc_keeps_what_the_source_says(spark, tmp_path):
    """A response read from a file keeps its identifier, date, headers and digests; whatever is null is made or counts as empty."""
    body = "HTTP/1.1 200 OK\r\nServer: x\r\nX-Y: a: b\r\n\r\n<title>T</title>hello"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-02-02T02:02:02Z\r\nWARC-Block-Digest: sha1:B\r\nWARC-Payload-Digest: sha1:P\r\nContent-Length: {len(body)}\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes((head + body + "\r\n\r\n" + head[:-4] + "\r\nX: cut\r\n\r\nHTTP/1.1 2").encode())
    read = warc.read(spark, str(tmp_path / "in"))
    assert sorted(r["complete"] for r in read.collect()) == [False, True]
    for r in warc.derive(warc.responses_of(read.filter("complete"))).collect():
        assert (r["refers_to"], r["warc_date"], r["target_uri"], r["source_block_digest"], r["source_payload_digest"]) == ("<urn:uuid:1>", "2020-02-02T02:02:02Z", "http://a/", "sha1:B", "sha1:P")
        assert r["block"] == "T\nhello" if r["record_type"] == "conversion" else all(x in r["block"] for x in ("source-http-Server: x", "source-http-X-Y: a: b", "title: T", "source-block-digest: sha1:B"))
    nothing = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, None, None, None, "<p>x", None, "sha1:B", None), (1, None, None, None, None, None, None, None)],
        "page_id bigint, target_uri string, warc_date string, http_headers string, payload string, record_id string, block_digest string, payload_digest string")
    got = warc.derive(nothing).collect()
    assert len({r["record_id"] for r in got}) == 6 and {r["warc_date"] for r in got} == {warc.NO_DATE} and sum(r["source_block_digest"] == "sha1:B" for r in got) == 2


def test_many_equal_responses_have_identifiers_of_their_own(spark):
    made = spark.createDataFrame([(1, "http://a/", "<p>same")] * 300 + [(2, "http://a/", "<p>same")], PAGES).repartition(7)
    got = [r["record_id"] for r in warc.derive(warc.responses(made)).collect()]
    assert len(set(got)) == len(got) == 602
    assert sorted(got) == sorted(r["record_id"] for r in warc.derive(warc.responses(made.repartition(3))).collect())


@pytest.mark.parametrize("size", [3_000, 4_001, 100_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_quoted_values_of_any_length(size, quote):
    link = "http://a/" + "x" * size
    page = f"<p>one <img src={quote}data:{'>' * size}{quote}> two<a class=b href={quote}{link}{quote}>three</a>"
    assert warc.parsed(page) == ("one two" + "three", None, None, [link])
    assert warc.parsed(f"a <b title={quote}{'y' * size} > c").text == f"a <b title={quote}{'y' * size} > c"


def test_tags_end_where_the_whole_pattern_says():
    """The reader that remembers what failed against one pattern that tries everything from every place."""
    whole = re.compile(r"""<a((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>""")
    rng = random.Random(31)
    for _ in range(3000):
        page, dead = "".join(rng.choice(["<a", " ", '"', "'", ">", "x", "<"]) for _ in range(rng.randint(1, 40))), {}
        for m in re.finditer("<a", page):
            found = whole.match(page, m.start())
            assert warc._tag_end(page, m.end(), dead) == (found.end() - 1 if found else -1), page


@pytest.mark.parametrize("part", ["<script>", "<p ", '<a "', "<!--", "<title>", "<a href='", "</script", "<style><script>", "<a \"'", "<a '<a \"", "<a \"<a '\" '<a \"'"])
def test_pages_are_read_in_linear_time(part):
    began = time.process_time()
    warc.parsed(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 5


def parts(url):
    m = re.match(r"(?s)(?:.*?)://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def test_url_rules_and_trees(spark):
    rng = random.Random(9)
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/q?x=http://b.net/es/", "http://com", "http://com/", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/"]
    urls += [f"http://{rng.choice(['a', 'b', 'www'])}.h{rng.randrange(9)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(99)}" for _ in range(300)]
    made = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    got = {r["page_id"]: r for r in url_filter.judge(made).collect()}
    for k, u in enumerate(urls):
        host, path = parts(u)
        fit = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, best[0])
        assert got[k]["verdict"] == best[1] if best[1] else got[k]["verdict"] in ("allow", "block")
    assert url_filter.judge(made.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(made.filter("page_id < 4")).collect()} == {"allow"}


def test_url_trees_judge_by_lexical_features(spark):
    """Every URL has a host of its own, so only its shape tells; the rules' suffixes do not occur among the unruled."""
    plain = lambda k, tld: f"http://site{k:03}.{tld}/en/{k:03}"
    odd = lambda k, tld, first: f"http://very-cheap-pills-{k:03}.{tld}/{first}/{k:03}?a=1&b=2"
    urls = [plain(k, "com") for k in range(150)] + [odd(k, "net", "es") for k in range(150)]
    urls += [plain(k, "org") for k in range(50)] + [odd(k, "org", "en") for k in range(50)]
    made = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    got = {r["page_id"]: r for r in url_filter.judge(made).collect()}
    assert len(got) == len(urls) and all(got[k]["rule"] is None for k in range(300, 400))
    assert {got[k]["verdict"] for k in range(300, 350)} == {"allow"} and {got[k]["verdict"] for k in range(350, 400)} == {"block"}


def plain_url(url):
    """The features of one URL, without shares, and its suffixes."""
    host, path = parts(url)
    url = url or ""
    share = [n / len(url) for n in Counter(url).values()]
    shape = [len(url), len(host), len(path), len(re.findall("/[^/]", path)), host.count("."), host.count("-"), sum(c in "0123456789" for c in url) / max(1, len(url))]
    shape += [len(re.findall("[?&][^&#]+", url)), float("#" in url), -sum(x * np.log2(x) for x in share), max(map(len, host.split(".")))]
    first, last = re.match("/([^/]*)", path), re.search(r"[^/.]\.([A-Za-z0-9]{1,8})\Z", path)
    return shape, {"host": host, "domain": ".".join(host.split(".")[-2:]), "top": host.split(".")[-1], "segment": first[1] if first else "", "extension": last[1].lower() if last else ""}


def test_url_features_against_plain_version(spark):
    urls = ["http://a.b.com/x.HTML", "http://b.com/y.html?q=1&r=#f", "http://c-d.net/", "http://C-d.net/v1.2/z", None, "", "http://é.org/ü/" + "z9" * 60_000, "http://b.com/a/b//c?", "x://"]
    rows = url_filter.with_parts(spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES))
    got = {r["page_id"]: r for r in url_filter.with_shares(url_filter.with_features(rows), url_filter.suffix_counts(rows)).collect()}
    made = [plain_url(u) for u in urls]
    counts = {s: Counter(m[1][s] for m in made) for s in url_filter.SUFFIXES}
    for k, (shape, suffix) in enumerate(made):
        wanted = shape + [counts[s][suffix[s]] / len(urls) for s in url_filter.SUFFIXES]
        assert [got[k][f] for f in url_filter.FEATURES] == pytest.approx(wanted), urls[k]


def test_url_trees_agree_with_labels_held_out(spark):
    """Hosts of all kinds; what is blocked has many hyphens or parameters and a common first part. The trees beat the commoner verdict by far."""
    rng = random.Random(4)
    rules = (("allow", "com", "/"), ("block", "com", "/buy/"), ("block", "net", "/buy/"), ("allow", "org", "/wiki/"))
    urls = [f"http://{'-'.join(rng.choice('abcd') * 3 for _ in range(rng.randint(1, 3)))}.{rng.choice(['com', 'net', 'org', 'info'])}/{rng.choice(['buy', 'buy', 'wiki', 'a', 'b'])}/{rng.randrange(9999)}" for _ in range(3000)]
    made = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    n, share, balanced, prior = url_filter.agreement(made, rules)
    assert n > 100 and share > 0.95 and balanced > 0.95 and prior < 0.7
    got = url_filter.judge(made, rules).collect()
    ruled, others = [[r["verdict"] for r in got if (r["rule"] is None) == free] for free in (False, True)]
    assert abs(ruled.count("block") / len(ruled) - others.count("block") / len(others)) < 0.15


def test_cuts_come_near_the_prior(spark):
    cut = lambda scores, prior: url_filter.cut_to_prior(spark.createDataFrame([(s,) for s in scores], "score double"), prior)
    assert cut([0.1, 0.2, 0.3, 0.4], 0.25) == 0.4 and cut([0.1, 0.2, 0.3, 0.4], 0.5) == 0.3
    assert cut([0.1] + [0.9] * 9, 0.8) == 0.9 and cut([0.9] * 5, 0.8) == 0.9 and cut([], 0.3) == url_filter.BLOCK_FROM


def brute_removed(rows):
    """By row: the bytes that stay, and the runs that go; rows in order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [1000, 1])
def test_suffix_dedup_is_brute_force(spark, docs, heavy, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_ONE_IN", 1)
    rows = sorted(texts())
    want = dict(zip((i for i, _ in rows), brute_removed([t for _, t in rows])))
    got = suffix_dedup.dedup_digests(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_equal_stretches_are_told_by_their_bytes():
    """Every stretch carries a digest of all its bytes; windows that follow each other with one anchor cover each text exactly once."""
    rng = random.Random(18)
    parts = [words(rng, 80).encode(), b"ab" * 300, b"x" * 99, words(rng, 300).encode()]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    row, start, n, key, whole = suffix_dedup._stretches_of(data, ends - [len(p) for p in parts], ends, np.zeros(0, np.uint64))
    seen = []
    for r, a, k, w in zip(row.tolist(), start.tolist(), n.tolist(), whole):
        assert hashlib.blake2b(data[a : a + k + 99].tobytes(), digest_size=16).digest() == w.tobytes()
        seen += [(r, p) for p in range(a, a + k)]
    assert seen == [(r, p) for r, (e, t) in enumerate(zip(ends.tolist(), parts)) for p in range(e - len(t), e - 99)]


def test_suffix_dedup_orders_equal_ids_by_text(spark, doubled):
    rows = sorted(((r["doc_id"], r["text"]) for r in doubled.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = Counter(tuple(r) for r in suffix_dedup.dedup_digests(doubled).collect())
    assert got == Counter((i, *m) for (i, _), m in zip(rows, brute_removed([t for _, t in rows])))
    assert suffix_dedup.dedup_digests(empty(spark)).count() == 0


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "_made", {})
    rng = random.Random(10)
    long = words(rng, 6000)
    rows = [long, words(rng, 50) + long[9_000:22_000] + words(rng, 50), "ab " * 3000, long[:500] * 3]
    made = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(rows)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_digests(made).collect()}
    assert got == dict(enumerate(brute_removed(rows)))
    kept = suffix_dedup.dedup_texts(made)
    assert kept.columns == made.columns and all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in kept.collect())


@pytest.mark.parametrize("run", [3, 1 << 12])
def test_fingerprints_of_hot_ids_and_rows(spark, monkeypatch, run):
    """A third of the rows with one id, a third without, a hot row: the order, by hand, of all rows."""
    monkeypatch.setattr(fingerprints, "RUN", run)
    rows = [(k, f"own words of number {k} and no other") for k in range(40)]
    rows += [(7, f"one of many texts of seven, {k}") for k in range(40)] + [(None, f"without an id, {k}" if k else None) for k in range(40)]
    rows += [(7, "the very same")] * 30 + [(3, None)] * 5
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (1 << 64 if h >> 63 else 0)
    inf = float("inf")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-inf if r[0] is None else r[0], signed(r[1])), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        other, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i if i is not None else -1, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
    made = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in made.collect()) == sorted(want)


def test_dedup_texts_keeps_clashing_columns(spark, docs):
    kept = suffix_dedup.dedup_texts(docs)
    assert kept.columns == docs.columns and kept.filter("gid <> -1 or spans <> 'own'").count() == 0
    assert {25, 26} <= {r["doc_id"] for r in kept.collect()} and 21 not in {r["doc_id"] for r in kept.collect()}


def test_numbering(spark, doubled):
    got = [r["gid"] for r in numbered(doubled).collect()]
    assert sorted(got) == list(range(doubled.count()))


def test_sharding(spark, docs, doubled):
    for table in (docs, doubled):
        got = sharding.shard_rows(table).collect()
        n = table.count()
        assert sorted(r["shuffled"] for r in got) == list(range(n))
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(by.get(s, [])) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        again = sharding.shard_rows(table.repartition(3)).collect()
        assert Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in again) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got)
    by_id = dict(texts())
    for r in sharding.shard_rows(docs).collect():
        raw = (by_id[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None
    assert sharding.shard_rows(empty(spark)).count() == 0


@pytest.mark.parametrize("aim", [1, 1 << 20])
def test_a_hot_row_is_dealt_in_runs(spark, monkeypatch, aim):
    found = []
    for run in (7, 1 << 14):
        monkeypatch.setattr(sharding, "RUN", run)
        monkeypatch.setattr(sharding, "BUCKET_ROWS", aim)
        rows = spark.range(300).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "if(id % 3 = 0, 'hot', cast(id AS string)) AS text")
        found.append(sorted((r["row_no"], r["doc_id"], r["text_crc32"]) for r in sharding.shard_rows(rows).collect()))
    assert found[0] == found[1] and [r[0] for r in found[0]] == list(range(300))
    at = [k for k, i, crc in found[0] if crc == zlib.crc32(b"hot")]
    assert len(at) == 100 and at == list(range(at[0], at[0] + 100))


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, rows):
    made = sharding.permuted(spark.range(rows).withColumnRenamed("id", "n"), "n", rows, 5, "out")
    assert sorted(r["out"] for r in made.collect()) == list(range(rows))
