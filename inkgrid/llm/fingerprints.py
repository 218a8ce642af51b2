"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Column expressions only. A text's five-word shingles are hashed once; the leading bits of a hash name its bin, the rest
is its value, and a bin keeps the least value. An empty bin takes the value of a filled one, chosen by hashes of the bin
alone, the same for every text. The low byte of each bin is kept, two hex digits a bin.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import bucket_of, cut, partitions, plain_ids

WORDS = 5
BINS = 256
BIN_BITS = 8
VALUE_BITS = 48
#: Tries by fixed probe tables before an empty bin ranks all filled bins; either way the choice hangs on hashes only.
PROBES = 8
#: Rows that repeat are written out in runs of at most so many, so that a hot row is spread over tasks.
RUN = 1 << 12
NEVER = (1 << VALUE_BITS) - 1


def _probes() -> list[list[int]]:
    draw = random.Random(11)
    return [[draw.randrange(BINS) for _ in range(BINS)] for _ in range(PROBES)]


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the low byte of each bin (array<int>), or null for a text without a word.

    A text of fewer than five words has one shingle, all its words. Words are runs of characters other than white space.
    """
    hashes, made, sorted_, vals, held = (f"__{out}_{k}" for k in ("w", "s", "o", "v", "h"))
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), "")
    keep = F.lit((1 << (BIN_BITS + VALUE_BITS)) - 1)
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(hashes)
    shingles = F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (WORDS - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WORDS)]).bitwiseAND(keep),
    )
    whole = F.array(F.xxhash64(h).bitwiseAND(keep))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(made, F.when(F.size(h) >= WORDS, shingles).when(F.size(h) > 0, whole).otherwise(none))
    never = F.array(*[F.lit((k << VALUE_BITS) | NEVER) for k in range(BINS)])
    df = df.withColumn(sorted_, F.sort_array(F.concat(F.col(made), never)))
    o = F.col(sorted_)
    first = F.filter(o, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(o, i - 1), VALUE_BITS)))
    low = lambda x: F.when(x.bitwiseAND(F.lit(NEVER)) != NEVER, x.bitwiseAND(F.lit(255)).cast("int"))
    df = df.withColumn(vals, F.transform(first, low))
    v = F.col(vals)
    df = df.withColumn(held, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(v, j).isNotNull()))
    tables = [F.array(*[F.lit(j) for j in row]) for row in _probes()]
    ranked = lambda i: F.array_min(F.transform(F.col(held), lambda j: F.struct(F.xxhash64(i, j, F.lit(5)).alias("rank"), j.alias("bin"))))["bin"]
    dense = F.transform(v, lambda x, i: F.coalesce(x, *[F.get(v, F.get(t, i)) for t in tables], F.get(v, ranked(i))))
    df = df.withColumn(out, F.when(F.size(held) > 0, dense))
    return df.drop(hashes, made, sorted_, vals, held)


def packed(sketch: str) -> Column:
    """The sketch as hex; a text without words has the empty fingerprint ''."""
    digits = F.array(*[F.lit(f"{k:02x}") for k in range(256)])
    return F.coalesce(F.array_join(F.transform(F.col(sketch), lambda x: F.get(digits, x)), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less what b-bit values share by chance.

    Two texts without words are alike (1), one without words and one with are not (0).
    """
    chance = 2.0**-BIN_BITS
    same = F.size(F.filter(F.zip_with(F.col(a), F.col(b), lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    return (
        F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0))
        .when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0))
        .otherwise(F.greatest((same - chance) / (1 - chance), F.lit(0.0)))
    )


def _pieces(rows: DataFrame, wanted: int) -> tuple[Column, int]:
    """The piece of each row (doc_id, mix), ascending in (doc_id, nulls first; mix), and how many pieces there are.

    Pieces are ranges of doc_id. An id that fills several of them, null too, has pieces of its own, by ranges of mix.
    """
    at = F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 20 * wanted) if wanted > 1 else F.lit(None)
    found = rows.agg(at.alias("at"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    times = Counter(found["at"] or [])
    hot = {v: k + 1 for v, k in times.items() if k > 1}
    splits = sorted(set(times) | {v + 1 for v in hot})
    parts = [1 + wanted * found["nulls"] // max(found["n"], 1), 1, *[hot.get(v, 1) for v in splits]]
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket_of(F.col("doc_id"), splits) + 1)
    table = lambda values: F.get(F.array(*[F.lit(v) for v in values]), bucket)
    first = [sum(parts[:k]) for k in range(len(parts))]
    inside = F.floor((F.col("mix") / F.lit(2.0**64) + 0.5) * table(parts)).cast("int")
    return table(first) + F.least(inside, table(parts) - 1), sum(parts)


def fingerprint_edits(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text (its second half replaced from the next document).

    The next document is the next one by descending doc_id (null ids last, equal ids by a hash of the text), after the last the
    first. Rows are dealt once, into ranges of that order; the first row of a range also goes, as a guest, to the range before,
    whose last row needs it. Where ids repeat or are null, equal rows are counted first: all but the last of them have their own
    text as the next one. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for
    each row; null texts count as empty. A lone row is its own next one; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    plain = plain_ids(docs)
    if plain:
        rows = rows.withColumns({"mix": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    else:
        rows = cut(rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("mix", F.xxhash64("text")))
    piece, pieces = _pieces(rows, buckets_per_partition * partitions(docs.sparkSession))
    rows = rows.withColumn("piece", piece)
    heads = {r["piece"]: r["head"] for r in rows.groupBy("piece").agg(F.max(F.struct("doc_id", "mix")).alias("head")).collect()}
    order = sorted(heads)
    before = {p: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    lookup = lambda values, kind: F.get(F.array(*[F.lit(values.get(k)).cast(kind) for k in range(pieces)]), F.col("piece"))
    own, guest = (F.struct(p.alias("piece"), F.lit(g).alias("guest")) for p, g in ((F.col("piece"), False), (lookup(before, "int"), True)))
    head_id, head_mix = (lookup({p: h[c] for p, h in heads.items()}, "bigint") for c in ("doc_id", "mix"))
    is_head = F.col("doc_id").eqNullSafe(head_id) & (F.col("mix") == head_mix)
    rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "mix", "copies", "at.*")
    rows = with_sketch(rows.repartition("piece"), "text", "sketch")
    onward = Window.partitionBy("piece").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("mix"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(onward)).withColumn("next_sketch", F.lead("sketch").over(onward))
    rows = rows.filter(~F.col("guest")).withColumn("n_chars", F.char_length("text").cast("long"))
    if not plain:
        last, others = (F.struct(n.alias("copies"), F.lit(own).alias("own")) for n, own in ((F.lit(1).cast("long"), False), (F.col("copies") - 1, True)))
        rows = rows.withColumn("part", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last)))).withColumns(
            {"copies": F.col("part.copies")} | {f"next_{c}": F.when(F.col("part.own"), F.col(c)).otherwise(F.col(f"next_{c}")) for c in ("text", "sketch")}
        )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch")
    made = rows.select(
        "copies",
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed("sketch").alias("fingerprint"),
        packed("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
    if plain:
        return made.drop("copies")
    runs = made.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})"))).repartition("doc_id", "edited_sha256", "run")
    alike = F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("copies")) - 1)
    return runs.withColumn("copy", F.explode(alike)).drop("copies", "run", "copy")
