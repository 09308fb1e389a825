"""Aggregates of k-mers: distinct sets, counts, statistics, postings, inverted indexes, presence patterns, prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.specs import Seed
from .kmers import counted, counted_each, kmers, multi_k


def distinct_sets(df: DataFrame, seed: Seed, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """keys, kmer, once each."""
    return counted(df, seed, keys, seq).drop("n")


def cardinality(df: DataFrame, seed: Seed, seq: str = "seq") -> DataFrame:
    """n: distinct k-mers of all sequences."""
    return counted(df, seed, (), seq).agg(F.count(F.lit(1)).alias("n"))


def kmer_counts(df: DataFrame, seed: Seed, seq: str = "seq") -> DataFrame:
    """kmer, n over all sequences."""
    return counted(df, seed, (), seq)


def count_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


def multi_k_sets(df: DataFrame, ks: Sequence[int], seq: str = "seq", canonical: bool = True) -> DataFrame:
    """k, kmer, once each, in order."""
    return multi_k(df, ks, (), seq, canonical).select("k", "kmer").orderBy("k", "kmer")


def multiset_stats(df: DataFrame, seed: Seed, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """keys, distinct, total, squares: k-mers of each key, their counts' sum and sum of squares."""
    rows = counted_each(df, seed, keys[0], seq) if len(keys) == 1 else counted(df, seed, keys, seq)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))


def prefix_sums(df: DataFrame, order: str, value: str, to: str, bucket: int = 1 << 20) -> DataFrame:
    """df with the sum of value over all rows of lesser order (a whole number; ties in any order).

    Rows are summed inside ranges of `bucket` numbers; ranges, one row each, are summed in one window.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / bucket))
    ahead = rows.groupBy("_b").agg(F.sum(value).alias("_s")).withColumn("_ahead", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(ahead.select("_b", "_ahead"), "_b").withColumn(to, F.col("_in") + F.col("_ahead")).drop("_b", "_in", "_ahead")


def postings(df: DataFrame, seed: Seed, ref: str = "id", seq: str = "seq") -> DataFrame:
    """kmer, positions: global places of each k-mer's last letter, references laid end to end in order of ref."""
    laid = prefix_sums(df.select(ref, seq, F.length(seq).alias("_len")), ref, "_len", "_begin")
    found = kmers(laid, seed, ["_begin"], seq)
    return found.groupBy("kmer").agg(F.sort_array(F.collect_list(F.col("_begin") + F.col("pos") + seed.span - 1)).alias("positions"))


def inverted_index(df: DataFrame, seed: Seed, ref: str = "id", seq: str = "seq") -> DataFrame:
    """kmer, ids: the references that hold each k-mer, in order."""
    return counted_each(df, seed, ref, seq).groupBy("kmer").agg(F.sort_array(F.collect_list(ref)).alias("ids"))


def chunk_cardinality(df: DataFrame, seed: Seed, chunk: int, ref: str = "id", seq: str = "seq") -> DataFrame:
    """ref, chunk, n: distinct k-mers that begin in each stretch of a sequence."""
    return kmers(df, seed, [ref], seq).groupBy(ref, F.floor(F.col("pos") / chunk).alias("chunk")).agg(F.count_distinct("kmer").alias("n"))


def accepted(df: DataFrame, accept: DataFrame) -> DataFrame:
    """The rows whose kmer is in the accept list."""
    return df.join(accept.select("kmer"), "kmer", "left_semi")


def accepted_in_order(rows: DataFrame, accept: DataFrame, value: str, order: str) -> DataFrame:
    """The rows whose value is in the accept list, in the order that they had (a column)."""
    return rows.join(accept.select(value), value, "left_semi").orderBy(order)


def presence(sets: DataFrame, group: str, trivial: bool = False, n_groups: int | None = None) -> DataFrame:
    """kmer, pattern: the groups that hold each k-mer, in order. Patterns of one or all groups go unless `trivial`.

    sets: distinct (group, kmer). n_groups, if known, saves counting them.
    """
    rows = sets.groupBy("kmer").agg(F.sort_array(F.collect_list(group)).alias("pattern"))
    if trivial:
        return rows
    n = n_groups if n_groups is not None else sets.select(group).distinct().count()
    return rows.filter((F.size("pattern") > 1) & (F.size("pattern") < n))


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """pattern, n."""
    return patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def screen(reads: DataFrame, index: DataFrame, seed: Seed, read: str = "id") -> DataFrame:
    """read, ref, hits: distinct k-mers that each read shares with each reference of an inverted index."""
    return counted_each(reads, seed, read).join(index, "kmer").select(read, F.explode("ids").alias("ref")).groupBy(read, "ref").agg(F.count(F.lit(1)).alias("hits"))


def length_histogram(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.groupBy(F.length(seq).alias("len")).agg(F.count(F.lit(1)).alias("n"))
