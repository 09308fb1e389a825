"""From documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

Defined results. The stages take nulls, empty texts and repeated rows as their operators say; an empty table passes
through. Repeated rows that survive are packed as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import exact_dedup, mixing, packing, perplexity, simhash
from strandloom.llm.common import written


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return perplexity.keep_good(docs, perplexity.trusted_labels(spark, sf_dir))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.dedup_exact(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup, five-word shingles at a similarity of 0.8: one document of each group stays."""
    return simhash.dedup_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row per piece, with its sequence and its place there."""
    import public_tokenizers

    return packing.pack(written(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [("quality", good_text), ("exact", no_copies), ("near", no_near_copies), ("mix", mixed), ("pack", packed)]

#: Perplexities and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
