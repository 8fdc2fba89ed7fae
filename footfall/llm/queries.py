"""One query for each operator, on the whole table that it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm import decontaminate, html_text, imatch, lines, mixing, oracle, quality, runs, secrets, simhash, substrings, tokens, toxicity, tries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokens.load())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(_table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    counts = [secrets.number("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(F.encode(secrets.written("base"), "UTF-8"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"), F.col("judged"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "begins")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.find_runs(runs.with_planted_periods(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    written = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.encode(written, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
    best = {"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period"), "exponent_milli": F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long")}
    return out.select("doc_id", "n_runs", *[c.alias(name) for name, c in best.items()], "runs_sha256", "collapsed_sha256")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), stratum="lang", alpha=0.05, delta=0.05)
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "rejected_by")


def op13_conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_tree(tries.with_shared_starts(tries.sequences(_table(spark, sf_dir, "conversations"))))


OPERATORS = (
    op1_token_counts, op2_substring_dedup, op3_simhash_near_dedup, op4_decontamination, op5_imatch_fingerprints, op6_secret_scan, op7_html_text, op8_source_mix, op9_toxicity,
    op10_line_dedup, op11_periodic_runs, op12_quality_rules, op13_conversation_tree,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """SQL for the exact, word-based operators; the others hash, learn or align, and are tested against plain versions."""
    return {"op2_substring_dedup": oracle.OP2, "op8_source_mix": oracle.OP8, "op10_line_dedup": oracle.OP10, "op12_quality_rules": oracle.OP12, "op13_conversation_tree": oracle.OP13}
