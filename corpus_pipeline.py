"""A corpus pipeline: each stage's rows are written as Parquet and read back as the next one's documents.

Defined cases, for every stage: null and empty texts stay (they are not toxic, no copies of
anything, hold no benchmark words and no secrets) and pack as their end id; very long texts are
taken whole; of rows that repeat an id each stands for itself, and rows without an id stay unless
their text is a near copy; equal rows are copies of which one stays; an empty table gives an empty
table; other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, near_dedup, packing, secrets, toxicity
from llm.common import free_names, joined, swept, written
from llm.tokens import word_bpe_path
from momenta.sources.files import remove, scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (mark,) = free_names(docs, "score")
    return toxicity.score(docs, toxicity.fit(docs, labels), name=mark).where(F.col(mark) < 0.5).drop(mark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of four-word shingles, as op5) the document with the smallest id stays."""
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # ids don't name rows: numbers do, in a copy that keeps them
    (row,) = free_names(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(rows, row).join(rows.select(row, "doc_id"), row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    stays = written(joined(found, found.groupBy("component_id").agg(F.min(order).alias("first")), ["component_id"]).where(F.col(row) == F.col(f"first.{row}")).select(row), "stays")
    return rows.join(stays, row, "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (mark,) = free_names(docs, "contamination")
    return decontaminate.annotate(docs, items, name=mark).where(F.size(F.col(mark)["hits"]) == 0).drop(mark)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences for training, with their token ids."""
    return packing.pack(docs, word_bpe_path(), with_ids=True)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("secrets", secret), ("packing", packed)]

#: No SQL: the first stage fits a model, the last one encodes with a tokenizer.
ORACLE_SQL = None


@swept
def kept(spark: SparkSession, stage: Callable, path: str, sf_dir: str, out: str) -> DataFrame:
    """A stage's rows, written and read back; what the stage itself had written goes."""
    stage(spark, spark.read.parquet(path), sf_dir).write.parquet(out)
    return spark.read.parquet(out)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table goes when the next one's is written."""
    path, rows = f"{sf_dir}/documents.parquet", None
    for name, stage in STAGES:
        before, out = path if rows else None, scratch(spark, f"pipeline-{name}")
        rows = kept(spark, stage, path, sf_dir, out)
        if before:
            remove(spark, before)
        path = out
    return rows
