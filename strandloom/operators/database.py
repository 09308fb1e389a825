"""K-mer to taxid databases: common ancestors, depths, genome counts, and two-phase minimized maps.

A database is built with one shuffle, by k-mer: the kernel folds the k-mers of each genome's batch, and a k-mer's genomes
are aggregated to the first and last of their depth-first numbers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.specs import Seed
from ..storage import written
from .kmers import Score, counted, score_minimizers, spans
from .taxonomy import lca_of_ranges

MODES = ("lex", "entropy", "tax_depth", "feature_count")


def lca_map(genomes: DataFrame, seed: Seed, tree: DataFrame, score: Score = "raw") -> DataFrame:
    """kmer, taxid: the common ancestor of all genomes (taxid, seq) that hold the k-mer. tree: nodes()."""
    numbered = genomes.join(tree.select("taxid", "ord"), "taxid")
    return lca_of_ranges(spans(numbered, seed, "ord", "seq", score).drop("n"), tree)


def depth_map(database: DataFrame, tree: DataFrame) -> DataFrame:
    """kmer, taxid, depth."""
    return database.join(tree.select("taxid", "depth"), "taxid").select("kmer", "taxid", "depth")


def feature_map(genomes: DataFrame, seed: Seed, tree: DataFrame, genome: str = "genome") -> DataFrame:
    """kmer, taxid, n_genomes: in how many distinct genomes (genome, taxid, seq) the k-mer is, and their common ancestor.

    Where a genome is one row, batches are folded by k-mer and one shuffle does; else k-mers first meet by genome.
    """
    numbered = genomes.join(tree.select("taxid", "ord"), "taxid")
    n, kinds = genomes.agg(F.count(F.lit(1)), F.count_distinct(genome)).first()
    if n == kinds:
        ranges = spans(numbered, seed, "ord").withColumnRenamed("n", "n_genomes")
    else:
        rows = counted(numbered, seed, [genome, "ord"], "seq")
        ranges = rows.groupBy("kmer").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count_distinct(genome).alias("n_genomes"))
    return lca_of_ranges(written(ranges, "ranges"), tree)


def minimized_map(genomes: DataFrame, seed: Seed, scored: DataFrame, keys=("genome",)) -> DataFrame:
    """kmer, taxid: the k-mers that are the least-scored of a window of some genome. scored: kmer, taxid, score."""
    rows = score_minimizers(genomes, seed, scored.select("kmer", "score"), keys, "seq")
    return scored.select("kmer", "taxid").join(rows.select("kmer").distinct(), "kmer", "left_semi")


def build(genomes: DataFrame, seed: Seed, tree: DataFrame, mode: str = "lex") -> DataFrame:
    """kmer, taxid by one of MODES.

    lex and entropy take the minimizers of each genome by that score. tax_depth and feature_count first score all
    k-mers, then keep the least-scored of each window: the deepest common ancestor, or the fewest genomes.
    """
    if mode == "lex":
        return lca_map(genomes, seed, tree, "lexical" if seed.window > 1 else "raw")
    if mode == "entropy":
        return lca_map(genomes, seed, tree, "entropy")
    plain = Seed(seed.k, 0, seed.gaps, seed.canonical, seed.alphabet)
    if mode == "tax_depth":
        scored = depth_map(lca_map(genomes, plain, tree), tree).withColumn("score", -F.col("depth").cast("long"))
    elif mode == "feature_count":
        scored = feature_map(genomes, plain, tree).withColumn("score", F.col("n_genomes"))
    else:
        raise ValueError(f"mode is one of {MODES}")
    return minimized_map(genomes, seed, scored)


def histogram(database: DataFrame) -> DataFrame:
    """taxid, n: k-mers per taxid, fewest first."""
    return database.groupBy("taxid").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "taxid")


def save(database: DataFrame, seed: Seed, path: str, buckets: int = 0) -> None:
    """The database and its seed. buckets: writes so many files by k-mer, so that equal k-mers meet in one."""
    rows = database.repartition(buckets, "kmer").sortWithinPartitions("kmer") if buckets else database
    rows.write.mode("overwrite").parquet(f"{path}/kmers")
    facts = json.dumps({"k": seed.k, "w": seed.w, "gaps": seed.gaps, "canonical": seed.canonical, "alphabet": seed.alphabet})
    database.sparkSession.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/seed")


def bucketed(database: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """The database as a table of the catalog, dealt and sorted by k-mer: a probe shuffles what it asks, never the database."""
    to = database.repartition(buckets, "kmer").write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer")
    (to.option("path", path) if path else to).saveAsTable(table)
    return database.sparkSession.table(table)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Seed]:
    facts = json.loads(spark.read.text(f"{path}/seed").first()[0])
    return spark.read.parquet(f"{path}/kmers"), Seed(facts["k"], facts["w"], tuple(facts["gaps"]), facts["canonical"], facts["alphabet"])


def look_up(database: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (kmer, ...) with taxid, null if the database has none."""
    return asked.join(database.hint("merge"), "kmer", "left")
