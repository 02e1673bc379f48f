"""Registered queries of the text operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.llm import collocations, decontamination, discriminant, hilbert, language, licenses, lines, packing, rules, runs, simhash, tokens, toxicity
from threatlake.llm.common import read
from threatlake.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"), "stays"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discriminant.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.summary(licenses.scan(read(spark, sf_dir, "documents")))
    return found.drop("matches").withColumnRenamed("id", "doc_id")


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.shard_documents(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(read(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(F.col("id").alias("doc_id"), *[f"stats.{c}" for c in counts], "base_failed", "kept", "posterior")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__exact").alias("n_exact"), F.col("__near").alias("n_near"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_table(read(spark, sf_dir, "documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents, those whose id has a CRC-32 that ends in 0 with a tail that repeats a stretch."""
    digits = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    rows = docs.select("doc_id", "text", digits.alias("h"), F.floor(digits / 10).alias("g"))
    own = rows.withColumn("ws", F.when(F.col("doc_id").isNotNull() & (F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    own = own.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    place = "if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8)))"
    tail = F.expr(f"array_join(transform(sequence(0L, n - 1L), i -> ws[cast({place} as int)]), ' ')")
    return own.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periodic_tails(read(spark, sf_dir, "documents")))
    listing = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1 "
                  "WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 ELSE int(x.period - y.period) END)[0]")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listing, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(collocations.phrases(read(spark, sf_dir, "documents")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_best_fit_packing, op3_decontamination, op4_quality_classifier, op5_license_scan,
        op6_hilbert_shards, op7_quality_rules, op8_language_id, op9_line_dedup, op10_token_counts,
        op11_periodic_runs, op12_collocations, op13_toxicity,
    )
}
