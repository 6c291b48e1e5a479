"""Exact dedup by content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stage

#: A chunk ends after 64 to 1024 characters: at a line end or where three neighbouring characters fall into these classes
#: (about one place in sixty of prose), so that an edit moves the boundaries near it only. What is left at the end is a chunk.
CHUNK = r"(?s).{64,1024}?(?:[aeo][ ,.][a-dt]|\n)|.{1,1024}"


def chunks(text):
    """The content-defined chunks of a text column; joined together they are the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``_id``, ``_recipe`` (its chunks' 64-bit identifiers in order), ``_size``, ``_sha``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    return one.select(
        "_id",
        F.transform(chunks(F.col("_text")), lambda c: F.xxhash64(c)).alias("_recipe"),
        F.octet_length("_text").alias("_size"),
        F.sha2("_text", 256).alias("_sha"),
    )


def ambiguous_ids(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Identifiers that two different chunks share: each distinct chunk moves once, then identifiers alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.explode(chunks(text)).alias("_chunk")).select(F.xxhash64("_chunk").alias("_chunk_id"), "_chunk")
    return each.distinct().groupBy("_chunk_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_chunk_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which rows have equal texts, and which of them stays.

    A text becomes a recipe: the ordered identifiers of its content-defined chunks. Identifiers are verified over all
    distinct chunks; a recipe that holds an identifier of two different chunks also carries the text's SHA-256, so equal
    recipes are equal texts. Long texts move only as distinct chunks, never whole.

    Returns a row for each row of ``docs``: doc_id, keep_id (largest id of the rows with that text), group_size, kept,
    text_sha256. A null text counts as empty; empty texts are equal. Repeated rows (same id and text) are each returned and
    count each; if their id is the largest they are all kept. A null id is smaller than any other. Very long texts are many chunks. An empty table gives an
    empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    made = stage(recipes(docs, id_col, text_col), "recipes")
    shared = stage(ambiguous_ids(docs, text_col), "ambiguous")
    if shared.isEmpty():
        made = made.withColumn("_fix", F.lit(""))
    else:
        hit = made.select("_id", "_sha", F.explode("_recipe").alias("_chunk_id")).join(shared, "_chunk_id", "left_semi").select("_sha").distinct()
        made = made.join(hit.withColumn("_fix", F.col("_sha")), "_sha", "left").withColumn("_fix", F.coalesce("_fix", F.lit("")))
    key = ["_recipe", "_size", "_fix"]
    groups = stage(made.groupBy(*key).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "groups")
    out = join_hot(made, groups, key, "_n", ["_id"], "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
