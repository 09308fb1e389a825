"""New taxa from presence patterns: score patterns of clades, find containment, emit the best as nodes.

Patterns are far fewer than k-mers, so after the fold to (pattern, n) the plans are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_checked, written
from .sets import pattern_counts, presence


def subtree_patterns(rows: DataFrame, tree: DataFrame, near: DataFrame) -> DataFrame:
    """parent, clades, pattern, n: for each parent of two clades or more, its children's presence patterns of k-mers.

    rows: (taxid, kmer), repeats allowed; near: closure(tree), which lets a k-mer stand for all nodes above it. A k-mer meets
    once per parent; the number of clades with k-mers follows from the patterns. Patterns of one or all clades are left out.
    """
    edges = near.join(tree.filter("parent <> 0").select(F.col("taxid").alias("anc"), "parent"), "anc").select("taxid", F.col("anc").alias("clade"), "parent")
    placed = join_checked(rows, written(edges, "edges"), "taxid").select("parent", "kmer", "clade")
    folded = placed.groupBy("parent", "kmer").agg(F.sort_array(F.collect_set("clade")).alias("pattern")).groupBy("parent", "pattern").agg(F.count(F.lit(1)).alias("n"))
    folded = written(folded, "patterns")
    sizes = folded.select("parent", F.explode("pattern").alias("clade")).groupBy("parent").agg(F.count_distinct("clade").alias("clades"))
    return folded.join(sizes.filter("clades >= 2"), "parent").filter((F.size("pattern") > 1) & (F.size("pattern") < F.col("clades"))).select("parent", "clades", "pattern", "n")


def node_scores(patterns: DataFrame) -> DataFrame:
    """patterns with score: k-mers times the clades that the pattern leaves out."""
    return patterns.withColumn("score", (F.col("clades") - F.size("pattern")) * F.col("n"))


def best(patterns: DataFrame, most: int, partition: str | None = None) -> DataFrame:
    """The `most` highest scores, overall or per partition; ties by parent and pattern."""
    order = [F.desc("score"), "parent", "pattern"]
    if partition is None:
        return patterns.orderBy(*order).limit(most)
    return patterns.withColumn("_r", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def emit(patterns: DataFrame, largest: int, most: int) -> DataFrame:
    """taxid, score, parent, children: the best patterns as new nodes, numbered on from the largest taxid."""
    top = best(patterns, most)  # `most` rows
    number = F.row_number().over(Window.orderBy(F.desc("score"), "parent", "pattern"))
    return top.select((number + largest).cast("long").alias("taxid"), "score", "parent", F.concat_ws(",", F.col("pattern").cast("array<string>")).alias("children"))


def room(taxa: int) -> int:
    """How many new nodes fit before the number of taxa reaches the next power of two."""
    return (1 << max(0, taxa - 1).bit_length()) - taxa


def containment(patterns: DataFrame) -> DataFrame:
    """upper, lower: pairs of patterns of which the first strictly holds the second.

    A pair shares the lower pattern's first clade, so it is found by an equi-join on a clade, not by trying all pairs.
    """
    up = patterns.select(F.col("pattern").alias("upper"), F.explode("pattern").alias("clade"))
    low = patterns.select(F.col("pattern").alias("lower"), F.element_at("pattern", 1).alias("clade"))
    inside = (F.size(F.array_except("lower", "upper")) == 0) & (F.size("lower") < F.size("upper"))
    return up.join(low, "clade").filter(inside).select("upper", "lower")


def addition_scores(patterns: DataFrame, n_groups: int) -> DataFrame:
    """pattern, score: n times the groups left out, plus the n times the size of each pattern inside; -1 if there is none."""
    inner = containment(patterns).join(patterns.select(F.col("pattern").alias("lower"), "n"), "lower").groupBy("upper").agg(F.sum(F.col("n") * F.size("lower")).alias("inner"))
    both = patterns.join(inner, patterns["pattern"] == inner["upper"], "left")
    return both.select("pattern", F.when(F.col("inner").isNull(), F.lit(-1)).otherwise(F.col("n") * (n_groups - F.size("pattern")) + F.col("inner")).cast("long").alias("score"))


def condense(patterns: DataFrame, most: int) -> list[dict]:
    """The `most` best patterns in order of choice; each takes over the score of the patterns inside it, which then go.

    Runs on the driver over `most` rows at most, each chosen by score before.
    """
    left = {tuple(r["pattern"]): {**r.asDict(), "pattern": tuple(r["pattern"])} for r in best(node_scores(patterns), most).collect()}
    out = []
    while left:
        top = max(left.values(), key=lambda r: (r["score"], [-x if isinstance(x, int) else 0 for x in r["pattern"]]))
        del left[top["pattern"]]
        inside = [r for r in left.values() if r["parent"] == top["parent"] and set(r["pattern"]) < set(top["pattern"])]
        for r in inside:
            top["score"] += (top["clades"] - len(top["pattern"])) * r["n"]
            del left[r["pattern"]]
        out.append(top)
    return out


def group_patterns(sets: DataFrame, group: str) -> DataFrame:
    """pattern, n over the groups of sets, trivial patterns left out."""
    return pattern_counts(presence(sets, group))
