"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meetspark.llm import contexttree, html, jaccard, mixing, neighbours, packing, quality, spotsigs, tokenfiles, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likenesses."""
    return spotsigs.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a language model of those that are not held out."""
    return contexttree.language_scores(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract_articles(_table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, among all vectors."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back through their index."""
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by their 5-word shingles."""
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of documents."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {x.__name__: x for x in (op1_best_fit_packing, op2_document_fingerprints, op3_language_scores, op4_html_extraction, op5_nearest_neighbours, op6_token_files, op7_mixing, op8_ngram_jaccard, op9_quality_classifier, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_html_extraction": html.ORACLE_SQL, "op5_nearest_neighbours": neighbours.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op8_ngram_jaccard": jaccard.ORACLE_SQL}
