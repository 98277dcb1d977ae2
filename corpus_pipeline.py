"""Corpus preparation in five stages, each applying one operator to all that the stage before it kept.

Toxic documents go, one of each group of equal texts stays, one of each group of near copies stays,
sources are mixed to their target weights (a document taken twice stands twice), and what the mix took is
packed into token sequences.  Every stage's result is written as Parquet in the shared folder and read
again, so a lost executor never costs more than the stage it was lost in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendflow.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lendflow.llm.common import scratch_path
from lendflow.sources.tables import read_table

SHINGLE_WORDS, SIMILARITY = 5, 0.8   # near copies


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by a field trained on the labelled ones among them."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    mark = "toxicity"
    while mark in docs.columns:
        mark += "_"
    return toxicity.score(docs, model, out=mark).where(F.col(mark) < 0.5).drop(mark)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of documents linked by five-word shingles."""
    found = near_dedup.near_dedup(docs, width=SHINGLE_WORDS, threshold=SIMILARITY)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.  Rows that repeat an id are taken alike."""
    taken = mixing.mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("n"))
    taken = taken.select(F.col("doc_id").alias("id"), F.expr("sequence(1, n)").alias("turns"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"))
    return (packed.join(taken, F.col("own").eqNullSafe(F.col("id")))
            .select("row", F.explode("turns")).select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document taken twice gives its pieces twice."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack)]

# SQL expresses neither the field's scores nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
