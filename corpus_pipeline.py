"""From raw documents to token counts and digests: four stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.bpe import encode_documents
from lumenframe.llm.common import cut, documents, fresh
from lumenframe.llm.minhash import near_duplicates
from lumenframe.llm.mixing import mix_sources
from lumenframe.llm.toxicity import fit_toxicity, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. An empty table stays empty."""
    net, score = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "toxicity score")
    return docs.withColumn(score, toxicity(net, "text")).where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id.

    Five-word shingles, similarity 0.8. Documents without words or without a doc_id have no group and stay. Of rows
    with one doc_id the first by text stays.
    """
    kept, row = near_duplicates(docs).where("kept").select("doc_id").distinct(), fresh(docs, "row of id")
    one = Window.partitionBy("doc_id").orderBy("text")
    unique = docs.join(kept, "doc_id", "left_semi").withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    return unique.select(docs.columns).union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: taken / size copies, rounded up or down by a seeded hash of doc_id.

    Documents without words add nothing to any source and stay once. Columns may have any names.
    """
    of, copies, copy = (fresh(docs, name) for name in ("id of", "copies", "copy"))
    rates = mix_sources(docs).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("rate"))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    counts = rates.select(F.col("doc_id").alias(of), F.coalesce(F.floor(F.col("rate") + part), F.lit(1)).cast("int").alias(copies))
    met = docs.join(counts, F.col("doc_id").eqNullSafe(F.col(of)))
    return met.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and of the decoded text. An empty table stays empty."""
    return encode_documents(docs)


STAGES = [("drop_toxic", drop_toxic), ("drop_copies", drop_copies), ("mix", mix), ("encode", encode)]

#: Neither the network's scores nor byte-pair encoding can be written in SQL; tests hold the pipeline to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
