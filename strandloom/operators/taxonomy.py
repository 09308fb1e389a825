"""Trees of taxa: closure, depth, distance, common ancestors, descendants, ranks, renumbering.

A tree is a table (taxid, parent), the root 1 with parent 0. Its closure is made by doubling jumps, so a tree of depth d
takes about log2(d) joins. Nodes are numbered in depth-first order: the common ancestor of any set of nodes is that of
its first and its last, so a set is aggregated by min and max alone, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

# The ranks in order, from the top; a rank's place is its level.
RANKS = (
    "no rank", "root", "superkingdom", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass",
    "class", "subclass", "infraclass", "cohort", "superorder", "order", "suborder", "infraorder", "parvorder",
    "superfamily", "family", "subfamily", "tribe", "subtribe", "genus", "subgenus", "species group", "species subgroup",
    "species", "subspecies", "varietas", "forma",
)

#: Doublings before a tree is taken for a cycle.
MOST_DOUBLINGS = 20


def closure(tree: DataFrame) -> DataFrame:
    """taxid, anc, dist: every node with itself and all its ancestors. A written table; a cycle is an error."""
    edges = tree.select("taxid", "parent").filter("parent <> 0 AND parent <> taxid").distinct()
    jumps = written(edges.select("taxid", F.col("parent").alias("anc")), "jumps")
    every = tree.select("taxid").union(edges.select("parent")).distinct().select("taxid", F.col("taxid").alias("anc"), F.lit(0).alias("dist"))
    for step in range(MOST_DOUBLINGS):
        if not jumps.limit(1).count():
            return written(every, "closure")
        up = jumps.select(F.col("taxid").alias("_at"), F.col("anc").alias("_to"))
        farther = every.join(up, every["anc"] == up["_at"]).select("taxid", F.col("_to").alias("anc"), (F.col("dist") + (1 << step)).alias("dist"))
        every = every.unionByName(farther)
        if step % 3 == 2:  # else the plan would double with every step
            every = written(every, "closure")
        jumps = written(jumps.join(up, jumps["anc"] == up["_at"]).select("taxid", F.col("_to").alias("anc")), "jumps")
    raise ValueError("the tree has a cycle")


def nodes(tree: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """taxid, path (root to node), depth, ord (depth-first number). A written table.

    Numbering sorts the tree's nodes, not what refers to them, in one task.
    """
    near = closure(tree) if near is None else near
    paths = near.groupBy("taxid").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), "anc"))), lambda s: s["anc"]).alias("path"))
    return written(paths.select("taxid", "path", F.size("path").alias("depth"), F.row_number().over(Window.orderBy("path")).cast("long").alias("ord")), "nodes")


def common(a: Column, b: Column) -> Column:
    """The last node that two paths share; 1 if they share none."""
    shared = F.array_intersect(a, b)
    return F.when(F.size(shared) > 0, F.element_at(shared, -1)).otherwise(F.lit(1))


def lca_of_ranges(ranges: DataFrame, tree: DataFrame, to: str = "taxid") -> DataFrame:
    """ranges (lo, hi: first and last depth-first number of a set) with the common ancestor; one lookup per distinct range."""
    a = tree.select(F.col("ord").alias("lo"), F.col("path").alias("_a"))
    b = tree.select(F.col("ord").alias("hi"), F.col("path").alias("_b"))
    found = ranges.select("lo", "hi").distinct().join(a, "lo").join(b, "hi").select("lo", "hi", common(F.col("_a"), F.col("_b")).alias(to))
    return ranges.join(found, ["lo", "hi"]).drop("lo", "hi")


def lca_by(df: DataFrame, keys: Sequence[str], tree: DataFrame, taxid: str = "taxid", to: str = "lca") -> DataFrame:
    """keys and the common ancestor of their taxids; 0 is left out, a set of nothing else gives 0; unknown nodes give null."""
    number = tree.select(F.col("taxid").alias(taxid), "ord")
    rows = df.join(number, taxid, "left")
    known = F.col(taxid) != 0
    sums = rows.groupBy(*keys).agg(
        F.min(F.when(known, F.col("ord"))).alias("lo"), F.max(F.when(known, F.col("ord"))).alias("hi"),
        F.count(F.when(known & F.col("ord").isNull(), 1)).alias("_lost"), F.count(F.when(known, 1)).alias("_n"),
    )
    good = lca_of_ranges(sums.filter("_lost = 0 AND _n > 0").select(*keys, "lo", "hi"), tree, to)
    rest = sums.filter("_lost > 0 OR _n = 0").select(*keys, F.when(F.col("_n") == 0, F.lit(0)).cast(dict(good.dtypes)[to]).alias(to))
    return good.select(*keys, to).unionByName(rest)


def lca_pairs(pairs: DataFrame, tree: DataFrame, a: str, b: str, to: str = "lca") -> DataFrame:
    """pairs with the common ancestor of two columns: equal ids are theirs, 0 is neutral, an unknown node gives null."""
    x = tree.select(F.col("taxid").alias(a), F.col("path").alias("_a"))
    y = tree.select(F.col("taxid").alias(b), F.col("path").alias("_b"))
    asked = pairs.select(a, b).distinct().join(x, a, "left").join(y, b, "left")
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    found = F.when(F.col(a) == F.col(b), F.col(a)).when(F.col(a) == 0, F.col(b)).when(F.col(b) == 0, F.col(a)).when(known, common(F.col("_a"), F.col("_b")))
    return pairs.join(asked.select(a, b, found.alias(to)), [a, b])


def distance(near: DataFrame, pairs: DataFrame, leaf: str, root: str) -> DataFrame:
    """pairs with the edges from leaf up to root; null if root is no ancestor."""
    return pairs.join(near.select(F.col("taxid").alias(leaf), F.col("anc").alias(root), F.col("dist")), [leaf, root], "left")


def largest(tree: DataFrame) -> DataFrame:
    """largest: the greatest taxid that the tree names."""
    return tree.agg(F.greatest(F.max("taxid"), F.max("parent")).alias("largest"))


def parent_of(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """asked (taxid, ...) with parent, null for an unknown taxid."""
    return asked.join(tree.select("taxid", "parent"), "taxid", "left")


def rank_histogram(tree: DataFrame) -> DataFrame:
    """rank, n."""
    return tree.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def descendants(near: DataFrame, proper: bool = True) -> DataFrame:
    """anc, taxid: every node below each node."""
    return near.filter("dist > 0" if proper else "true").select("anc", "taxid")


def children(tree: DataFrame) -> DataFrame:
    """parent, children in order."""
    return tree.filter("parent <> 0").groupBy("parent").agg(F.sort_array(F.collect_set("taxid")).alias("children"))


def used(near: DataFrame, taxa: DataFrame) -> DataFrame:
    """The taxa and all their ancestors."""
    return near.join(taxa.select("taxid").distinct(), "taxid").select(F.col("anc").alias("taxid")).distinct()


def under(near: DataFrame, taxa: DataFrame, roots: DataFrame) -> DataFrame:
    """taxa rows that stand at or below one of roots."""
    inside = near.join(roots.select(F.col("taxid").alias("anc")), "anc", "left_semi").select("taxid").distinct()
    return taxa.join(inside, "taxid", "left_semi")


def level(rank: Column) -> Column:
    """Level of a rank's name; an unknown name is an error."""
    known = F.create_map(*[F.lit(x) for i, r in enumerate(RANKS) for x in (r, i)])
    return F.coalesce(F.element_at(known, rank), F.raise_error(F.concat(F.lit("unknown rank: "), rank)).cast("int"))


def sorted_taxa(tree: DataFrame) -> DataFrame:
    """taxid, parent, rank in order: deepest level first, then parent, then id; nodes without a rank last."""
    lvl = F.when(F.col("rank").isNotNull(), level(F.col("rank")))
    return tree.withColumn("level", lvl).orderBy(F.col("level").desc_nulls_last(), "parent", "taxid")


def genomes_below(near: DataFrame, genomes: DataFrame) -> DataFrame:
    """taxid, genomes: the distinct genomes of each node and all nodes below it, in order."""
    return near.join(genomes.select("taxid", "genome"), "taxid").groupBy(F.col("anc").alias("taxid")).agg(F.sort_array(F.collect_set("genome")).alias("genomes"))


def reform(tree: DataFrame, genomes: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree in which every genome has a taxid of its own: (tree, genomes, old -> new ids).

    Where several genomes share a taxid, each becomes a child of it; then ids are dense by depth and former id. The new
    ids before that are numbers past the largest, in order of taxid and genome.
    """
    top = largest(tree).first()[0] or 1
    many = genomes.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("taxid")))
    fresh = many.filter("_n > 1").withColumn("fresh", (F.row_number().over(Window.orderBy("taxid", "genome")) + top).cast("long"))
    more = tree.select(F.col("taxid").cast("long").alias("taxid"), F.col("parent").cast("long").alias("parent")).unionByName(fresh.select(F.col("fresh").alias("taxid"), F.col("taxid").cast("long").alias("parent")))
    more = written(more, "tree")
    deep = closure(more).groupBy("taxid").agg(F.count(F.lit(1)).alias("depth"))
    ids = written(deep.select("taxid", F.row_number().over(Window.orderBy("depth", "taxid")).cast("long").alias("new")), "ids")
    moved = more.join(ids, "taxid").join(ids.select(F.col("taxid").alias("parent"), F.col("new").alias("new_parent")), "parent", "left")
    own = many.filter("_n = 1").select("genome", F.col("taxid").cast("long").alias("taxid")).unionByName(fresh.select("genome", F.col("fresh").alias("taxid")))
    return moved.select(F.col("new").alias("taxid"), F.coalesce("new_parent", F.lit(0)).alias("parent")), own.join(ids, "taxid").select("genome", F.col("new").alias("taxid")), ids.select(F.col("taxid").alias("old"), "new")
