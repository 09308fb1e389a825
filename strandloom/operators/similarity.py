"""Similarity of sets of k-mers: exact for all pairs, and by sketches.

Pairs are counted from patterns: k-mers with the same set of holders are first folded to one row with a count, so a
k-mer that many share costs its pairs once per pattern, not once per k-mer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def holders(rows: DataFrame, group: str) -> DataFrame:
    """pattern, n: how many items each set of groups has in common, and no other group has. rows: (group, kmer), repeats allowed."""
    held = rows.groupBy("kmer").agg(F.sort_array(F.collect_set(group)).alias("pattern"))
    return held.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def intersections(patterns: DataFrame) -> DataFrame:
    """i, j, inter for all pairs i < j of groups that share an item; patterns of holders()."""
    folded = patterns.filter(F.size("pattern") > 1)
    pairs = folded.select("n", "pattern", F.posexplode("pattern").alias("at", "i")).select("n", "i", F.explode(F.slice("pattern", F.col("at") + 2, F.size("pattern"))).alias("j"))
    return pairs.groupBy("i", "j").agg(F.sum("n").alias("inter"))


def all_pairs(sets: DataFrame | None, group: str, zeros: bool = False, patterns: DataFrame | None = None) -> DataFrame:
    """i, j, inter, uni, jaccard, in_i, in_j for the pairs i < j of groups that share an item; sets: (group, kmer), repeats allowed.

    zeros adds the pairs that share nothing, so that the result is the whole triangle of groups. patterns: holders(sets), if
    it is there already, as a written table.
    """
    patterns = written(holders(sets, group), "patterns") if patterns is None else patterns  # one shuffle by item; sizes and pairs follow from it
    sizes = patterns.select(F.explode("pattern").alias(group), "n").groupBy(group).agg(F.sum("n").alias("size"))
    shared = intersections(patterns)
    a, b = sizes.select(F.col(group).alias("i"), F.col("size").alias("si")), sizes.select(F.col(group).alias("j"), F.col("size").alias("sj"))
    if zeros:  # asked for as a triangle: as many rows as pairs of groups
        sizes = written(sizes, "sizes")
        a, b = sizes.select(F.col(group).alias("i"), F.col("size").alias("si")), sizes.select(F.col(group).alias("j"), F.col("size").alias("sj"))
        both = a.join(b, F.col("i") < F.col("j")).join(shared, ["i", "j"], "left").na.fill(0, ["inter"])
    else:
        both = shared.join(a, "i").join(b, "j")
    uni = F.col("si") + F.col("sj") - F.col("inter")
    return both.select("i", "j", "inter", uni.alias("uni"), F.when(uni > 0, F.col("inter") / uni).otherwise(0.0).alias("jaccard"), (F.col("inter") / F.col("si")).alias("in_i"), (F.col("inter") / F.col("sj")).alias("in_j"))


def condensed_index(i: Column, j: Column, n: Column) -> Column:
    """Place of the pair i < j (from 0) in the upper triangle of an n by n matrix, row by row."""
    return F.floor(i * (2 * n - i - 1) / 2).cast("long") + j - i - 1


def nearest(pairs: DataFrame, k: int, i: str = "i", j: str = "j", by: str = "jaccard") -> DataFrame:
    """item, neighbor, value, place: the k most similar others of each item, ties by the neighbor."""
    both = pairs.select(F.col(i).alias("item"), F.col(j).alias("neighbor"), F.col(by).alias("value")).unionByName(pairs.select(F.col(j).alias("item"), F.col(i).alias("neighbor"), F.col(by).alias("value")))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("value"), "neighbor"))
    return both.withColumn("place", place).filter(F.col("place") <= k)


def bottom_k(rows: DataFrame, group: str, size: int, key: Column | None = None) -> DataFrame:
    """group, hash: the `size` least hashes of each group's items (group, kmer), repeats allowed.

    Ranks are cut before the shuffle too, so a task sends `size` hashes of a group at most.
    """
    hashed = rows.select(group, (F.xxhash64("kmer") if key is None else key).alias("hash"))
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy("hash"))
    return hashed.withColumn("_r", rank).filter(F.col("_r") <= size).select(group, "hash").distinct()


def bottom_k_sample(counts: DataFrame, group: str, size: int) -> DataFrame:
    """group, hash, kmer, n: a bottom-k sketch with the items and counts that its hashes stand for. counts: group, kmer, n, no repeats."""
    hashed = counts.select(group, F.xxhash64("kmer").alias("hash"), "kmer", "n")
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy("hash"))
    return hashed.withColumn("_r", rank).filter(F.col("_r") <= size).drop("_r")


def merged(sketches: DataFrame, size: int) -> DataFrame:
    """hash: the bottom-k sketch of the union of all groups."""
    return sketches.select("hash").distinct().orderBy("hash").limit(size)


def bottom_k_jaccard(sketches: DataFrame, group: str, size: int) -> DataFrame:
    """i, j, shared, jaccard from sketches: of the least `size` hashes of a pair's union, the share that both have.

    Pairs that share no hash have 0 and are left out; candidates come from an equi-join on the hash.
    """
    near = candidates(sketches, group)
    a, b = sketches.select(F.col(group).alias("i"), "hash"), sketches.select(F.col(group).alias("j"), "hash")
    union = near.join(a, "i").select("i", "j", "hash").unionByName(near.join(b, "j").select("i", "j", "hash"))
    counts = union.groupBy("i", "j", "hash").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("_r", F.row_number().over(Window.partitionBy("i", "j").orderBy("hash"))).filter(F.col("_r") <= size)
    return first.groupBy("i", "j").agg(F.sum((F.col("n") == 2).cast("long")).alias("shared"), F.count(F.lit(1)).alias("_n")).select("i", "j", "shared", (F.col("shared") / F.col("_n")).alias("jaccard"))


def hll(sets: DataFrame, keys: Sequence[str], log_size: int = 14, item: str = "kmer") -> DataFrame:
    """keys, sketch: HyperLogLog sketches; union them with hll_union_agg, read them with hll_sketch_estimate."""
    return sets.groupBy(*keys).agg(F.hll_sketch_agg(item, log_size).alias("sketch"))


def hll_cardinality(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def theta(sets: DataFrame, keys: Sequence[str], log_size: int = 12, item: str = "kmer") -> DataFrame:
    return sets.groupBy(*keys).agg(F.theta_sketch_agg(item, log_size).alias("sketch"))


def theta_jaccard(sketches: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """i, j, jaccard of the given pairs (i, j) of groups, from their theta sketches."""
    a = sketches.select(F.col(group).alias("i"), F.col("sketch").alias("a"))
    b = sketches.select(F.col(group).alias("j"), F.col("sketch").alias("b"))
    both = F.theta_sketch_estimate(F.theta_union("a", "b"))
    return pairs.select("i", "j").join(a, "i").join(b, "j").select("i", "j", F.when(both > 0, F.theta_sketch_estimate(F.theta_intersection("a", "b")) / both).otherwise(0.0).alias("jaccard"))


def candidates(sketches: DataFrame, group: str) -> DataFrame:
    """i, j: pairs i < j of groups that share a hash of their bottom-k sketches."""
    held = sketches.groupBy("hash").agg(F.sort_array(F.collect_list(group)).alias("g")).filter(F.size("g") > 1).select("g").distinct()
    return held.select(F.posexplode("g").alias("at", "i"), "g").select("i", F.explode(F.slice("g", F.col("at") + 2, F.size("g"))).alias("j")).distinct()


def quantized(value: Column, a: float, b: float, most: int) -> Column:
    """A sketch register of an exponentially distributed minimum: floor(1 - log_b(value * a)), from 0 to most."""
    return F.least(F.greatest(F.floor(1 - F.log(value * a) / F.log(F.lit(b))), F.lit(0)), F.lit(most)).cast("int")


def register_parameters(greatest: float, least: float, most: int) -> tuple[float, float]:
    """a, b for quantized(): registers from 0 for the greatest value to `most` for the least."""
    b = (greatest / least) ** (1 / most)
    return b / greatest, b


def matrix(pairs: DataFrame, by: str = "jaccard") -> DataFrame:
    """One row per i, one column per j."""
    return pairs.groupBy("i").pivot("j").agg(F.first(by))


def signatures(items: DataFrame, group: str, bands: int, rows: int) -> DataFrame:
    """group, bands: a key for each band; a band takes, for each of its rows, the least of the items' hashes under another seed."""
    mins = [F.min(F.xxhash64(F.lit(b * rows + r), "hash")).alias(f"m{b * rows + r}") for b in range(bands) for r in range(rows)]
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)])
    return items.groupBy(group).agg(*mins).select(group, keys.alias("bands"))


def classes(signed: DataFrame, group: str) -> DataFrame:
    """group, class: groups that agree in all bands are one class, called by its least group."""
    least = signed.groupBy("bands").agg(F.min(group).alias("class"))
    return signed.join(least, "bands").select(group, "class")


def banded(items: DataFrame, group: str, bands: int, rows: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): pairs i < j of classes that agree in a whole band, with the number of such bands; and group, class.

    Equal sets are one class, so a band that many equal groups share has one member. most: of each class, the pairs with
    most bands, that many at least.
    """
    signed = written(signatures(items, group, bands, rows), "signatures")
    member = written(classes(signed, group), "classes")
    each = signed.join(member.filter(F.col(group) == F.col("class")), group).select(group, F.explode("bands").alias("band"))
    held = each.groupBy("band").agg(F.sort_array(F.collect_list(group)).alias("g")).filter(F.size("g") > 1)
    folded = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))  # bands with the same members cost their pairs once
    pairs = folded.select(F.posexplode("g").alias("at", "i"), "g", "n").select("i", F.explode(F.slice("g", F.col("at") + 2, F.size("g"))).alias("j"), "n").groupBy("i", "j").agg(F.sum("n").alias("n"))
    if most is not None:
        pairs = written(pairs, "pairs")
        sides = pairs.select("i", "j", "n", F.col("i").alias("of")).unionByName(pairs.select("i", "j", "n", F.col("j").alias("of")))
        place = F.rank().over(Window.partitionBy("of").orderBy(F.desc("n")))
        pairs = sides.withColumn("_r", place).filter(F.col("_r") <= most).select("i", "j", "n").distinct()
    return pairs, member


def lsh_nearest(items: DataFrame, group: str, k: int, bands: int = 16, rows: int = 2, score: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(item, neighbor, value, place of classes; group, class): the k most similar classes of each, by exact Jaccard similarity.

    Three times as many candidates as asked for come from the bands and are ranked anew by their items (group, hash), which
    move once for each candidate. score: makes i, j, jaccard of candidates (i, j) where what the items come from moves cheaper.
    """
    pairs, member = banded(items, group, bands, rows, 3 * k)
    pairs = written(pairs.select("i", "j"), "candidates")
    if score:
        return nearest(written(score(pairs), "scored"), k), member
    only = member.filter(F.col(group) == F.col("class")).select(group)
    sets = written(items.select(group, "hash").join(only, group, "left_semi").distinct(), "items")
    sizes = sets.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    mine = pairs.join(sets.select(F.col(group).alias("i"), "hash"), "i")
    shared = mine.join(sets.select(F.col(group).alias("j"), "hash"), ["j", "hash"]).groupBy("i", "j").agg(F.count(F.lit(1)).alias("inter"))
    a, b = sizes.select(F.col(group).alias("i"), F.col("size").alias("si")), sizes.select(F.col(group).alias("j"), F.col("size").alias("sj"))
    scored = shared.join(a, "i").join(b, "j").select("i", "j", (F.col("inter") / (F.col("si") + F.col("sj") - F.col("inter"))).alias("jaccard"))
    return nearest(scored, k), member


def weighted_jaccard(counts: DataFrame, group: str) -> DataFrame:
    """i, j, jaccard of multisets (group, kmer, n): sum of least over sum of greatest counts, for pairs that share an item."""
    total = counts.groupBy(group).agg(F.sum("n").alias("t"))
    holders = counts.groupBy("kmer").agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), "n"))).alias("h")).filter(F.size("h") > 1)
    pairs = holders.select(F.posexplode("h").alias("at", "x"), "h").select("x", F.explode(F.slice("h", F.col("at") + 2, F.size("h"))).alias("y"))
    least = pairs.groupBy(F.col("x.g").alias("i"), F.col("y.g").alias("j")).agg(F.sum(F.least("x.n", "y.n")).alias("least"))
    a, b = total.select(F.col(group).alias("i"), F.col("t").alias("ti")), total.select(F.col(group).alias("j"), F.col("t").alias("tj"))
    return least.join(a, "i").join(b, "j").select("i", "j", (F.col("least") / (F.col("ti") + F.col("tj") - F.col("least"))).alias("jaccard"))
