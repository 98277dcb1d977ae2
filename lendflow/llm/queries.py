"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendflow.llm import (archives, collocations, exact_dedup, fertility, license_scan, mixing, near_dedup, neighbours, oracle, packing,
                          periodic_runs, substring_dedup, suffix_dedup, toxicity)
from lendflow.sources.tables import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@query("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    return license_scan.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs)


@query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return near_dedup.near_dedup(docs, width=3, threshold=0.85)


@query("op4_exact_dedup")
def op4_exact_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeated_words(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model, out="score").drop("text")
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeated_bytes(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_neighbours")
def op8_neighbours(spark, sf_dir):
    return neighbours.search(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_archives")
def op10_archives(spark, sf_dir):
    return archives.round_trip(read_table(spark, sf_dir, "pages"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_cycles(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.strongest())
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_collocations")
def op12_collocations(spark, sf_dir):
    return collocations.mine(read_table(spark, sf_dir, "documents", "text", "lang"))


@query("op13_fertility")
def op13_fertility(spark, sf_dir):
    return fertility.quality(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in REGISTRY}
