"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Each source gets a target in words. A document's expected copies are target / source size; their prefix sum runs over
the source's documents, one random offset per source is added, and a document is emitted once for each integer
boundary that its step crosses. Documents run in order of size class, so that every class gives its share and the words
taken come near the target.

Defined results. Null or empty text: size 0, copies as for any other, 0 words taken. Null source: a source of its own,
last in order. Null doc_id and repeated rows: rows of their own; equal rows share out their copies in any order. A
source without words: target 0, no copies. Empty table: no rows. Other columns are carried along untouched, whatever
their names.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, gapless, written

#: Rows that a window sorts together, about.
EACH = 20_000
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also weight, target: share of all sizes by weight, no target above most times its source.

    What a source can't take goes to the others by weight: in order of cap / weight, the first source whose cap holds
    the level that the ones before leave over ends the search, and every later one takes level * weight. One row per
    source is sorted in one task.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("_mx_rank", rank)
    ratio = F.lit(float(most)) * F.col("source_size") / F.col("weight")
    before = Window.orderBy("_mx_ratio", "_mx_rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        ranked.withColumn("_mx_ratio", ratio)
        .withColumn("_mx_all", F.sum("source_size").over(everything))
        .withColumn("_mx_w", F.sum("weight").over(everything))
        .withColumn("_mx_capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_mx_done", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    level = (F.lit(float(share)) * F.col("_mx_all") - F.lit(float(most)) * F.col("_mx_capped")) / (F.col("_mx_w") - F.col("_mx_done"))
    found = seen.withColumn("_mx_level", F.min(F.when(level <= F.col("_mx_ratio"), F.struct("_mx_ratio", "_mx_rank", level.alias("level")))).over(everything)["level"])
    target = F.least(F.col("_mx_level") * F.col("weight"), F.lit(float(most)) * F.col("source_size"))
    return found.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def with_copies(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42) -> DataFrame:
    """rows (a written table) with _mx_source_size, _mx_target and _mx_copies, how often the mix takes each row."""
    n = rows.count()
    digits = max(0, ceil(log(max(1, n / EACH), 16)))
    sizes = rows.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    group, size_class, key, sub, at, source = fresh(rows.columns, "group", "class", "key", "sub", "at", "of")
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias(source), F.col("source_size").alias("_mx_source_size"), F.col("target").alias("_mx_target"))
    digits_of = F.col(size_col).cast("string")
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = rows.withColumns({size_class: F.length(digits_of) * 100 + F.substring(digits_of, 1, 2).cast("int"), key: hashed, group: F.col(source_col)})
    ranked = gapless(keyed.withColumn(sub, F.substring(key, 1, digits)), [group], [size_class, sub], [key, id_col], at)
    # One row per source: the join broadcasts it if Spark knows it to be small, and a source's rows may be split.
    both = ranked.join(targets, F.col(group).eqNullSafe(F.col(source)))
    expected = F.when(F.col("_mx_source_size") > 0, F.col("_mx_target") / F.col("_mx_source_size")).otherwise(0.0)
    # 20 bits: the offset plus a whole number is exact
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group), F.lit("")))), 1, 5), 16, 10).cast("long") / F.lit(1 << 20)
    crossed = F.floor(start + expected * (F.col(at) + 1)) - F.floor(start + expected * F.col(at))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return both.withColumn("_mx_copies", copies).drop(size_class, key, sub, at, group, source)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the same columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of theirs meets one of ours
    own = dict(zip(docs.columns, names))
    sized = written(docs.toDF(*names).withColumn("_mx_size", word_count(F.col(own[text_col]))), "mix")
    taken = with_copies(sized, own[id_col], own[source_col], "_mx_size", **how).filter("_mx_copies > 0")
    return taken.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).select(*names).toDF(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(rows).select(
        "doc_id", "size", F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"), (F.col("_mx_copies") * F.col("size")).alias("taken")
    )


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources
), ratios AS (
  SELECT *, (2.0::DOUBLE * source_size) / weight AS ratio FROM weighed
), seen AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
    coalesce(sum(source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS done
  FROM ratios WINDOW before AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * all_size::DOUBLE - 2.0::DOUBLE * capped::DOUBLE) / (all_weight - done)::DOUBLE AS level FROM seen
), found AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1
), targets AS (
  SELECT source, source_size, least((SELECT level FROM found) * weight::DOUBLE, 2.0::DOUBLE * source_size) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY
    length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS place FROM sized
), steps AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS expected,
    ('0x' || substr(md5('42:' || coalesce(p.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, coalesce(target, 0) AS target,
  (least(floor(start + expected * (place + 1)) - floor(start + expected * place), 2)::BIGINT * size)::BIGINT AS taken
FROM steps
"""
