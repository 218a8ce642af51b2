"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written as Parquet
before the next one starts, so that a lost executor costs one stage at most. All stages take null and empty texts as texts
without words, treat repeated rows alike, leave other columns as they are, and give no rows for an empty table.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from inkgrid.llm import decontaminate, ngram_join, quality, sentencepiece_codec, suffix_dedup
from inkgrid.llm.common import shared_dir, table

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects, as quality.keep_good does; none without a classifier."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the least doc_id; of equal rows one, as ngram_join.one_of_each does."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also stand earlier, by doc_id and text; documents that are nothing else go, null and empty ones stay."""
    return suffix_dedup.dedup_texts(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget; null and empty ones hold none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text (null stays null) and piece ids of the documents left, their digests, and whether decoding gives the text again."""
    return sentencepiece_codec.encoded(docs, shown="text")


STAGES = [
    ("quality_classifier", drop_poor),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", encode),
]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.

    What lies between them is in the shared folder; a stage's rows go once the next stage's are written. Those that the last
    stage reads stay, since it is lazy.
    """
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
