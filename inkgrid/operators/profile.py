"""What recogniser output and documents hold: families of blocks, guesses by pattern and place, probes, comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a block's text looks like, by family; the strings a document is probed for.
FAMILIES = {
    "dates": r"20[0-9]{2}[.\-/][0-9]{2}[.\-/][0-9]{2}",
    "refs": r"(?i)(?:AMM|TSM)[A-Z0-9\-.]+",
    "license_fragments": r"(?i)CAACML|CAAC|CAA|CA",
    "digit_3_5": r"^[0-9]{3,5}$",
    "english_fault": r"[A-Za-z][A-Za-z0-9,./\\\- ]{12,}",
}
PROBES = ("TSM", "AMM", "2238", "348", "CAAC", "Fault", "COND AFT")
# Guesses by name: family, bounds of the middle's x and y (all exclusive, None: unbounded), and how many are shown.
GUESSES = {
    "fault_ref": ("refs", None, None, None, None, 5),
    "fault_report_en": ("english_fault", None, None, 360, 520, 3),
    "apu_cum_hours": ("digit_3_5", 300, 400, 850, None, 5),
    "apu_cum_cycles": ("digit_3_5", 390, 480, 850, None, 5),
    "awr_date": ("dates", None, None, 800, None, 5),
    "awr_license": ("license_fragments", None, None, None, None, 5),
}
PREVIEW = 5


def families(blocks: DataFrame) -> DataFrame:
    """A row for each block and each family it belongs to."""
    names = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in FAMILIES.items()]))
    return blocks.withColumn("family", F.explode(names))


def family_counts(blocks: DataFrame, by: str = "page_id") -> DataFrame:
    """How many blocks of each family a page has, one column for each."""
    return blocks.groupBy(by).agg(F.count("*").alias("blocks"), *[F.count_if(F.col("text").rlike(p)).alias(f"n_{n}") for n, p in FAMILIES.items()])


def _within(value: Column, low: float | None, high: float | None) -> Column:
    above = F.lit(True) if low is None else value > low
    return above if high is None else above & (value < high)


def guessed(blocks: DataFrame, guesses: dict = GUESSES) -> DataFrame:
    """A row for each block and each field that its text's shape and its middle's place suggest (guess, cx, cy added)."""
    rows = blocks.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2.0, "cy": (F.col("y1") + F.col("y2")) / 2.0})
    fits = lambda family, x1, x2, y1, y2, _: F.col("text").rlike(FAMILIES[family]) & _within(F.col("cx"), x1, x2) & _within(F.col("cy"), y1, y2)
    return rows.withColumn("guess", F.explode(F.array_compact(F.array(*[F.when(fits(*g), F.lit(n)) for n, g in guesses.items()]))))


def guess_previews(blocks: DataFrame, guesses: dict = GUESSES) -> DataFrame:
    """page_id, guess and the first few blocks that suggest it (text, score to four places, box, center), by sequence."""
    most = F.coalesce(*[F.when(F.col("guess") == n, g[-1]) for n, g in guesses.items()])
    entry = F.struct("block_seq", "text", F.round("score", 4).alias("score"), F.array("x1", "y1", "x2", "y2").alias("box"), F.array("cx", "cy").alias("center"))
    rows = guessed(blocks, guesses).groupBy("page_id", "guess").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    return rows.select("page_id", "guess", F.transform(F.slice("found", F.lit(1), most), lambda e: e.dropFields("block_seq")).alias("found"))


def comparison(blocks: DataFrame, title: str = "Recogniser output") -> DataFrame:
    """page_id, json, markdown: the counts of each family and the guesses of each page, as a document and as text."""
    counts = family_counts(blocks)
    shown = F.struct("guess", F.transform("found", lambda e: F.struct(*[e[c].alias(c) for c in ("text", "score", "box", "center")])).alias("found"))
    guesses = guess_previews(blocks).groupBy("page_id").agg(F.array_sort(F.collect_list(shown)).alias("guesses"))
    rows = counts.join(guesses, "page_id", "left").withColumn("guesses", F.coalesce("guesses", F.array().cast(guesses.schema["guesses"].dataType)))
    document = F.to_json(F.struct(F.struct(*[F.col(f"n_{n}").alias(n) for n in FAMILIES]).alias("counts"), F.map_from_entries("guesses").alias("field_guesses")))
    count_lines = [F.concat(F.lit(f"- {n}: "), F.col(f"n_{n}")) for n in FAMILIES]
    guess_lines = F.transform("guesses", lambda g: F.concat(F.lit("- "), g["guess"], F.lit(": "), F.array_join(F.transform(g["found"], lambda e: F.concat(F.lit("`"), e["text"], F.lit("`"))), ", ")))
    text = F.concat_ws("\n", F.concat(F.lit(f"# {title} "), F.col("page_id").cast("string")), F.lit(""), *count_lines, F.lit(""), F.array_join(guess_lines, "\n"))
    return rows.select("page_id", document.alias("json"), text.alias("markdown"))


def write_comparison(compared: DataFrame, path: str) -> None:
    """The documents as JSON lines and the texts as Markdown files, in two folders."""
    compared.select("json").write.mode("overwrite").text(f"{path}/json")
    compared.select("markdown").write.mode("overwrite").text(f"{path}/markdown")


def previews(candidates: DataFrame) -> DataFrame:
    """The first few candidates of each field as text:score."""
    shown = F.concat(F.col("text"), F.lit(":"), F.round("cand_score", 4).cast("string"))
    rows = candidates.filter(F.col("rank") <= PREVIEW)
    return rows.groupBy("page_id", "field_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s")))), lambda x: x["s"]), " / ").alias("preview"))


def probes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which of a few strings a document holds, whether it has a table, its length and its start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [text.contains(p).alias(f"has_{k}") for k, p in enumerate(PROBES)]
    return docs.select(key, *found, F.lower(text).contains("<table").alias("table_like"), F.char_length(text).alias("chars"), F.substring(text, 1, 500).alias("preview"))


def model_matrix(checks: DataFrame, models: DataFrame) -> DataFrame:
    """Every field of every page against every model; checkboxes, read by one rule, once.

    Both kinds of rows are told apart in one join, so that checks are worked out once. The models, some few names, are broadcast:
    a product of two dealt tables works out the one for every piece of the other.
    """
    known = models.select("model_name", F.lit(False).alias("__box"))
    rule = checks.sparkSession.range(1).select(F.lit("vision-rule").alias("model_name"), F.lit(True).alias("__box"))
    asked = F.broadcast(known.unionByName(rule))
    return checks.join(asked, (F.col("recognizer") == "checkbox") == F.col("__box")).drop("__box")


def model_summary(matrix: DataFrame) -> DataFrame:
    """How many values each model was asked for and which share passes."""
    return matrix.groupBy("model_name").agg(F.count("*").alias("asked"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
