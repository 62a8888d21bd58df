"""From raw documents to packed training bins: five stages, each written before the next reads it.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm import exact_dedup, jaccard_dedup, near_dedup, packing, quality, secret_scan
from annolytics.llm.common import free_names, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, scores at the threshold or above."""
    (score,) = free_names(docs, "score")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs, model, out=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs, exact_dedup.fresh_index(spark))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more over shingles of five words, the document
    with the smallest id.  Links of SimHash fingerprints (op8's BK-trees) are checked exactly first; MinHash bands add
    what fingerprints miss.  A pair at 0.8 is missed with probability 7e-5 (by law), a closer one less."""
    return jaccard_dedup.drop_similar(docs, linked=near_dedup.links)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in the text are replaced by their kind, and n_chars follows."""
    (spans,) = free_names(docs, "spans")
    found = secret_scan.with_spans(docs, out=spans)
    clean = found.withColumn("text", secret_scan.redacted("text", spans))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("redact_secrets", redact_secrets),
    ("pack_bins", pack_bins),
]

# A trained model, fingerprint classes and regex spans have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
