"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. Null ids,
null or empty texts, repeated rows and empty tables behave as the operators'
docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table, text_of
from chronoloom.llm.decontaminate import contaminated
from chronoloom.llm.line_dedup import line_dedup
from chronoloom.llm.near_copies import near_copies
from chronoloom.llm.packing import pack
from chronoloom.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """docs less the rows that share id (null included) and text with found(doc_id, text_hash)."""
    out = materialize(found.select(F.col("doc_id").alias("_out"), "text_hash").distinct(), name)
    same = F.col("doc_id").eqNullSafe(F.col("_out")) & (F.xxhash64(text_of(docs)) == F.col("text_hash"))
    return docs.select(*COLUMNS).join(out.hint("merge"), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject; rows that share id and text go together."""
    return without(docs, quality_rules(docs).filter("not kept"), "rejected")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later copies of repeated multi-line chunks; a document that had words and lost them all goes."""
    clean = line_dedup(docs)
    left = (F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("removed_chunks") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.filter(left).withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8 or more) stays: the one with the smallest id, once if its row is repeated.

    Rows without an id can't be told apart and stay.
    """
    firsts = near_copies(docs).filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    firsts = materialize(firsts, "firsts")
    once = docs.join(firsts.filter("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*COLUMNS)
    again = docs.join(firsts.filter("n > 1").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or its template."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark"), by_window=True), "contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Packing uses a tokenizer's merges, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None
