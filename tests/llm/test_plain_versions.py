"""The sketch of op5 and the permutation of op10, number by number, against plain versions of themselves."""

from __future__ import annotations

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from inkgrid.llm import fingerprints, sharding, warc


def hashed(*values, seed: int = 42) -> int:
    """Spark's xxhash64 of longs, ints, strings and arrays of longs: each value with the hash before as its seed; unsigned."""
    for v in values:
        for part in v if isinstance(v, list) else [v]:
            raw = part.encode() if isinstance(part, str) else struct.pack("<i" if isinstance(part, Int) else "<q", part)
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


class Int(int):
    """A number of four bytes."""


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text):
    words = [signed(hashed(w)) for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    keep = (1 << (fingerprints.BIN_BITS + fingerprints.VALUE_BITS)) - 1
    shingles = [hashed(*words[k : k + 5]) & keep for k in range(len(words) - 4)] if len(words) >= 5 else [hashed(words) & keep] if words else []
    bins: dict[int, int] = {}
    for s in shingles:
        value = s & ((1 << fingerprints.VALUE_BITS) - 1)
        if value != fingerprints.NEVER:
            bins[s >> fingerprints.VALUE_BITS] = min(value, bins.get(s >> fingerprints.VALUE_BITS, value))
    if not bins:
        return None
    probes = fingerprints._probes()

    def source(i):
        for table in probes:
            if table[i] in bins:
                return table[i]
        return min(bins, key=lambda j: (signed(hashed(Int(i), Int(j), Int(5))), j))

    return [bins[i if i in bins else source(i)] & 255 for i in range(fingerprints.BINS)]


def test_sketches_number_by_number(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "one two three four", "one two three four five", "é ü\tß\x0bx\fy z"]
    texts += [" ".join(str(rng.randrange(500)) for _ in range(n)) for n in (6, 40, 300, 3000)]
    made = fingerprints.with_sketch(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", "s")
    got = {r["k"]: r for r in made.withColumn("hex", fingerprints.packed("s")).collect()}
    for k, text in enumerate(texts):
        wanted = plain_sketch(text)
        assert got[k]["s"] == wanted and got[k]["hex"] == "".join(f"{x:02x}" for x in wanted or []), text


def test_likeness_is_corrected_for_chance(spark):
    """Equal bins less those that low bytes share by chance, for sketches without and with common bins."""
    rng = random.Random(1)
    a, b = ([rng.randrange(256) for _ in range(256)] for _ in range(2))
    half = a[:128] + b[128:]
    rows = spark.createDataFrame([(a, a), (a, b), (a, half), (None, None), (a, None)], "a array<int>, b array<int>")
    got = [r[0] for r in rows.select(fingerprints.likeness("a", "b")).collect()]
    plain = lambda x, y: max(0.0, (sum(p == q for p, q in zip(x, y)) / 256 - 1 / 256) / (255 / 256))
    assert got == pytest.approx([1.0, plain(a, b), plain(a, half), 1.0, 0.0])


def plain_place(number, rows, seed):
    a, b = sharding.sides(rows)
    while True:
        left, right = divmod(number, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + signed(hashed(right, Int(i), Int(seed))) % a) % a
            else:
                right = (right + signed(hashed(left, Int(i), Int(seed))) % b) % b
        number = left * b + right
        if number < rows:
            return number


@pytest.mark.parametrize("rows", [1, 2, 10, 97, 1000])
def test_permutation_number_by_number(spark, rows):
    made = sharding.permuted(spark.range(rows), "id", rows, 7, "to").collect()
    assert {r["id"]: r["to"] for r in made} == {k: plain_place(k, rows, 7) for k in range(rows)}


def test_very_long_texts_are_fingerprinted(spark):
    """A text of some megabytes beside short ones."""
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    rows = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(rows).collect()}
    assert got[1]["n_chars"] == len(long) and len(got[1]["fingerprint"]) == 512 and got[3]["fingerprint"] == ""


def test_conversion_against_another_reader():
    """Texts of random pages by a plain reader that walks through the signs one by one."""
    rng = random.Random(77)
    parts = ["<p>", "</p>", "<b>", "</b>", "word", " more ", "\n", "<br/>", "<!-- gone > -->", "<script>var x = '<p>';</script>", '<a href="u>v">', "</a>", "&amp;", "a < b", "<i title='>'>", "</i>"]

    def plain(page):
        out, at = "", 0
        while at < len(page):
            if page.startswith("<!--", at):
                out, at = out + " ", page.index("-->", at) + 3
            elif page.startswith("<script>", at):
                out, at = out + " ", page.index("</script>", at) + 9
            elif page[at] == "<" and at + 1 < len(page) and (page[at + 1].isalpha() or page[at + 1] == "/"):
                end, quote = at + 1, ""
                while quote or page[end] != ">":
                    quote = "" if quote and page[end] == quote else page[end] if not quote and page[end] in "'\"" else quote
                    end += 1
                name = re.match("/?([a-z]+)", page[at + 1 :])[1]
                out, at = out + ("\n" if name in ("p", "br") else ""), end + 1
            else:
                out, at = out + page[at], at + 1
        lines = (" ".join(x.split()) for x in out.replace("&amp;", "&").split("\n"))
        return "\n".join(x for x in lines if x)

    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert warc.parsed(page).text == plain(page), page
