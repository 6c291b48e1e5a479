"""A training corpus in stages; each reads what the one before it wrote.

All stages but the last return the columns of ``documents``. Rows with a null doc_id can't be told apart and leave in the
first stage. Rows that repeat an id are judged alike; exact dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import hyperminhash, mixing, packing, perplexity, recipes
from sparkloom.llm.common import stage
from sparkloom.llm.queries import MIX, labelled_domains


def _chosen(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity lies in their language's band."""
    return _chosen(docs, perplexity.quality(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat an id any one."""
    out = _chosen(docs, recipes.exact_dedup(docs))
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return out if unique else out.dropDuplicates(["doc_id"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id."""
    return _chosen(docs, hyperminhash.near_dedup(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the target weights of the domains ask for."""
    labels = labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ident, many = _unused(docs, "mixed_id"), _unused(docs, "copies")
    found = mixing.mixed(docs, labels, MIX, anchor="good").filter("copies > 0").groupBy(F.col("doc_id").alias(ident)).agg(F.max("copies").cast("int").alias(many))
    return docs.join(found, docs["doc_id"] == found[ident]).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(many))).alias(ident)).drop(ident)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2,048."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", packed)]

#: SQL can't express the language model, near-duplicate and mixing stages; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
