"""What a model says of a whole page's layout, read as VARIANT whatever its depth, and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import text as t

# Fixed value: how much of an answer is shown that has no fields.
PREVIEW = 800
MANY, NAMED = "array<variant>", "map<string,variant>"


def parsed(content: Column) -> Column:
    """An answer as VARIANT: the JSON object between its braces, else an object with the bare text.

    Objects that repeat a key are not read. Null stays null.
    """
    bare = F.to_variant_object(F.struct(content.alias("text")))
    return F.when(content.isNotNull(), F.coalesce(F.try_parse_json(t.json_inside(t.unfenced(content))), bare))


def _said(candidate: Column) -> Column:
    """A field's value as text: an object's `value`, else what stands there."""
    is_object = F.try_variant_get(candidate, "$", NAMED).isNotNull()
    return F.when(is_object, F.try_variant_get(candidate, "$.value", "string")).otherwise(F.try_variant_get(candidate, "$", "string"))


def summaries(answers: DataFrame) -> DataFrame:
    """Answers (content, raw, and what else there is) with summary, block_count, field_candidates (id to text) and raw_preview.

    An answer whose `field_candidates` is no object has null for these three and the start of its content, or else of `raw`, as
    raw_preview. Blocks are counted whether they come as an array or as an object; anything else counts as none.
    """
    rows = answers.withColumn("__v", parsed(F.col("content")))
    fields = F.try_variant_get("__v", "$.field_candidates", NAMED)
    size = F.coalesce(F.size(F.try_variant_get("__v", "$.blocks", MANY)), F.size(F.try_variant_get("__v", "$.blocks", NAMED)), F.lit(0))
    found = F.col("__fields").isNotNull()
    rows = rows.withColumn("__fields", fields).withColumns(
        {
            "summary": F.when(found, F.try_variant_get("__v", "$.summary", "string")),
            "block_count": F.when(found, size),
            "field_candidates": F.transform_values("__fields", lambda k, v: _said(v)),
            "raw_preview": F.when(~found, F.substring(t.first_filled(F.col("content"), F.col("raw")), 1, PREVIEW)),
        }
    )
    return rows.drop("__v", "__fields")
