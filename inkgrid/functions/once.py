"""A fence in a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The column that rows are dealt by all through an inspection.
KEY = "page_id"


def computed_once(df: DataFrame, *made: str) -> DataFrame:
    """The same rows; what their columns, or those that are named, are made of is no longer visible to what follows.

    The optimizer moves a filter below projections by writing out the columns it names. Over columns that are made of columns
    that are made of columns, such texts grow without end. A generator, here of one row for each row, stops that. KEY goes past
    the fence: rows that are dealt by it stay so, and what follows needs no shuffle. So do columns that are not named, where
    some are: those that nothing asks for any more are dropped before the fence, not carried on.
    """
    held = [c for c in df.columns if (c in made if made else c != KEY)]
    return df.select(*[c for c in df.columns if c not in held], F.inline(F.array(F.struct(*held)))).select(*df.columns)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys to as many tasks as the session has shuffle partitions.

    For steps that do much with few bytes: Spark measures shuffles by bytes and would fold such a step's into one or two tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a source that comes in fewer pieces than the session has shuffle partitions, dealt out; other sources as they are.

    Behind a fence, so that all that reads the rows reads one and the same shuffle, whatever columns it takes.
    """
    if df.rdd.getNumPartitions() >= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return computed_once(dealt(df, *keys))
