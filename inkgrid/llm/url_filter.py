"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

Column expressions and Spark ML only. The rules label the URLs they fit; the trees learn from those.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import cut

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Most labelled URLs that the trees are fitted on, and of ten parts of all URLs by hash the one that is held out of them.
SAMPLE, PARTS, HELD_OUT = 20_000, 10, 7
TREES, DEPTH, STEP = 30, 3, 0.1
#: Features that a split may choose from, so that no one suffix decides alone.
SUBSET = "sqrt"
#: Where rules and trees are compared; the cut for URLs without a rule is `cut_to_prior`'s.
BLOCK_FROM = 0.5
#: Suffixes are counted in so many cells, by hash: what is broadcast of them never grows beyond that.
CELLS = 1 << 18
#: What is counted over all pages: the host and its last one and two labels, the path's first part and its extension.
SUFFIXES = ("host", "domain", "top", "segment", "extension")
FEATURES = ["url_len", "host_len", "path_len", "depth", "dots", "hyphens", "digit_ratio", "params", "has_fragment", "entropy", "word_len", *[f"{s}_share" for s in SUFFIXES]]


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where url is null or has no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumns({"host": F.translate(part(1), upper, upper.lower()), "path": part(2)})


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name, verdict = F, F
    for k, (what, host, path) in enumerate(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = name.when(fits, F.lit(host + path)), verdict.when(fits, F.lit(what))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def suffixes() -> dict[str, Column]:
    """The stretches of host and path that SUFFIXES names."""
    return {
        "host": F.col("host"),
        "domain": F.substring_index("host", ".", -2),
        "top": F.substring_index("host", ".", -1),
        "segment": F.regexp_extract("path", r"\A/([^/]*)", 1),
        "extension": F.lower(F.regexp_extract("path", r"[^/.]\.([A-Za-z0-9]{1,8})\z", 1)),
    }


def with_features(pages: DataFrame) -> DataFrame:
    """Lexical features of url, host and path, and for every suffix its cell, `<suffix>_cell`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size = F.char_length("__url").cast("double")
    share = lambda c: (F.char_length("__url") - F.char_length(F.replace(F.col("__url"), c))) / F.greatest(size, F.lit(1.0))
    entropy = F.aggregate(
        F.array_distinct(F.filter(F.split(F.col("__url"), ""), lambda c: c != "")),
        F.lit(0.0),
        lambda total, c: total - share(c) * F.log2(F.greatest(share(c), F.lit(1e-9))),
    )
    cells = {f"{name}_cell": F.pmod(F.xxhash64(F.lit(name), part), F.lit(CELLS)).cast("int") for name, part in suffixes().items()}
    return pages.withColumn("__url", url).withColumns(
        {
            "url_len": size,
            "host_len": F.char_length("host").cast("double"),
            "path_len": F.char_length("path").cast("double"),
            "depth": count(F.col("path"), "/[^/]"),
            "dots": count(F.col("host"), "[.]"),
            "hyphens": count(F.col("host"), "-"),
            "digit_ratio": count(F.col("__url"), "[0-9]") / F.greatest(size, F.lit(1.0)),
            "params": count(F.col("__url"), "[?&][^&#]+"),
            "has_fragment": F.col("__url").contains("#").cast("double"),
            "entropy": entropy,
            "word_len": F.array_max(F.transform(F.split("host", "[.]"), lambda w: F.char_length(w))).cast("double"),
            **cells,
        }
    ).drop("__url")


def suffix_counts(rows: DataFrame) -> DataFrame:
    """(cell, n): how many pages' suffixes fall into each cell, over every page, no label among them; at most CELLS rows."""
    cells = with_features(rows).select(F.explode(F.array(*[f"{s}_cell" for s in SUFFIXES])).alias("cell"))
    return cut(cells.groupBy("cell").agg(F.count("*").alias("n")))


def with_shares(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `<suffix>_share`, the share of all pages in the suffix's cell, by broadcast of the cells: pages are not shuffled."""
    total = (counts.agg(F.sum("n")).first()[0] or len(SUFFIXES)) / len(SUFFIXES)
    for s in SUFFIXES:
        rows = rows.join(F.broadcast(counts.select(F.col("cell").alias(f"{s}_cell"), (F.col("n") / F.lit(total)).alias(f"{s}_share"))), f"{s}_cell")
    return rows


def _labelled(pages: DataFrame, rules) -> DataFrame:
    rule, verdict = rule_columns(rules)
    return with_parts(pages).withColumns({"rule": rule, "by_rule": verdict})


def fitted(rows: DataFrame, counts: DataFrame, sample: int = SAMPLE):
    """(trees, share of `block`), from at most `sample` URLs that have a `by_rule`, without the part held out; None if all of them agree.

    Both verdicts weigh the same together, so that a score of a half says that a URL looks as much like one as like the other,
    whichever is commoner.
    """
    labelled = rows.filter(F.col("by_rule").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(PARTS)) != HELD_OUT))
    few = cut(labelled.orderBy(F.xxhash64("url"), "url").limit(sample).withColumn("label", (F.col("by_rule") == "block").cast("double")))
    n, blocked = few.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, n):
        return None
    weighed = with_shares(with_features(few), counts).withColumn("weight", F.when(F.col("label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))))
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, featureSubsetStrategy=SUBSET, seed=3)
    return trees.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(weighed).select("features", "label", "weight")), blocked / n


def scored(rows: DataFrame, counts: DataFrame, trees) -> DataFrame:
    """Adds score, the trees' chance of `block`."""
    made = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_shares(with_features(rows), counts))
    return trees.transform(made).withColumn("score", vector_to_array("probability")[1])


def agreement(pages: DataFrame, rules=RULES) -> tuple[int, float, float, float]:
    """Over the rule-labelled URLs held out: how many, the share on which trees and rules agree, the mean of that share over both verdicts, and the share of the commoner verdict."""
    rows = _labelled(pages.select("page_id", "url"), rules)
    counts = suffix_counts(rows)
    trees, _ = fitted(rows, counts)
    out = rows.filter(F.col("by_rule").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(PARTS)) == HELD_OUT))
    same = ((F.col("score") >= BLOCK_FROM) == (F.col("by_rule") == "block")).cast("double")
    by = {r["by_rule"]: (r["n"], r["same"]) for r in scored(out, counts, trees).groupBy("by_rule").agg(F.count("*").alias("n"), F.sum(same).alias("same")).collect()}
    n = sum(x[0] for x in by.values())
    return n, sum(x[1] for x in by.values()) / n, sum(x[1] / x[0] for x in by.values()) / len(by), max(x[0] for x in by.values()) / n


def cut_to_prior(score: DataFrame, prior: float) -> float:
    """The score from which on URLs are blocked, so that their share comes as near to the rules' share as equal scores allow."""
    at = score.agg(F.percentile_approx("score", 1 - prior, 100_000).alias("v"), F.count("*").alias("n")).first()
    if not at["n"]:
        return BLOCK_FROM
    above, least, both = score.agg(F.count_if(F.col("score") > at["v"]), F.min(F.when(F.col("score") > at["v"], F.col("score"))), F.count_if(F.col("score") >= at["v"])).first()
    nearer = least is not None and abs(above / at["n"] - prior) <= abs(both / at["n"] - prior)
    return least if nearer else at["v"]


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' chance of `block`) of every row.

    A fitting rule's verdict stands, the longest rule's first. Other URLs are judged by trees fitted on at most SAMPLE
    rule-labelled URLs; what they see of suffixes is how many of all pages have them, never a label. Of the URLs without a rule
    those that look most like blocked ones are blocked, as large a share as the rules block. If all labels agree or there are
    none, the verdict of the rest is the labels' (allow without labels) and score is null. Null and odd URLs have
    empty parts and are judged like any other; repeated rows stay; other columns are ignored.
    """
    rows = _labelled(pages.select("page_id", "url"), rules)
    counts = suffix_counts(rows)
    made = fitted(rows, counts)
    if made is None:
        first = rows.filter("by_rule is not null").select("by_rule").first()
        return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(first[0] if first else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    trees, prior = made
    held = cut(scored(rows, counts, trees).select("page_id", "host", "path", "rule", "by_rule", "score"))
    by_trees = F.when(F.col("score") >= cut_to_prior(held.filter("by_rule is null"), prior), "block").otherwise("allow")
    return held.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "score")
