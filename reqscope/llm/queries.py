"""Registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, manifest
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL where SQL can express the operator.
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from . import quality

    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document (five-word shingles, Jaccard 0.8)."""
    from . import jaccard

    return jaccard.jaccard_classes(read(spark, sf_dir, "documents")).drop("nid")


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based n-gram score of every document."""
    from . import lm

    return lm.lm_scores(read(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    from . import packing

    return packing.pack_documents(read(spark, sf_dir, "documents"), ids=False)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of the text that is left, per document."""
    from pyspark.sql import functions as F

    from . import lines

    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, divergences from the language references and verdict of every document."""
    from . import rules

    docs = read(spark, sf_dir, "documents")
    return rules.judge(docs, rules.references(docs))


@query
def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document."""
    from pyspark.sql import functions as F

    from . import mixing

    labels = mixing.domain_labels(read(spark, sf_dir, "labels"))
    out = mixing.mixing_rates(read(spark, sf_dir, "documents"), labels, mixing.DOMAINS, anchor="clean")
    return out.select(F.col("nid").alias("doc_id"), "n_tokens", "p_clean", "p_low", "p_toxic", "rate")


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes, spans and a digest of what is left, per document."""
    from pyspark.sql import functions as F

    from . import suffix

    out = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and chunks, and a digest of what is left, per document."""
    from pyspark.sql import functions as F

    from . import chunks

    out = chunks.dedup_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "n_repeated",
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    from pyspark.sql import functions as F

    from . import neighbours

    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof digest and verification of every document; a seventh claims one character more."""
    out = manifest.document_manifest(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE["op11_merkle_manifest"] = manifest.oracle_sql()


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after three rounds with 16 centroids."""
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


ORACLE["op12_centroid_clustering"] = centroids.oracle_sql()


@query
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, places of the base phrases, license labels and score of every document."""
    from . import licenses

    return licenses.license_labels(read(spark, sf_dir, "documents"))
