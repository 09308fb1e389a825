"""Classification of reads: look up every k-mer, count hits per taxon, resolve them over the tree, render.

Every k-mer of a read is looked up, whatever window the database was built with. Hits are folded per read where they
are made; one shuffle brings a read's rows together, and the tree is resolved inside that row from the paths of its few
taxa.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.specs import Seed
from .kmers import kmers, parts


def resolve(hits: Column) -> Column:
    """Taxon of an array of (taxid, n, path): the node whose path to the root has most hits, ties to their ancestor, none 0."""
    on_path = lambda t: F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + F.when(F.array_contains(t["path"], x["taxid"]), x["n"]).otherwise(F.lit(0)))
    scored = F.transform(hits, lambda t: F.struct(on_path(t).alias("score"), t["path"].alias("path")))
    best = F.array_max(F.transform(scored, lambda s: s["score"]))
    tied = F.transform(F.filter(scored, lambda s: s["score"] == best), lambda s: s["path"])
    shared = F.aggregate(tied, F.element_at(tied, 1), lambda a, p: F.array_intersect(a, p))
    return F.when(F.size(hits) > 0, F.coalesce(F.element_at(shared, -1), F.lit(1))).otherwise(F.lit(0))


def classify(reads: DataFrame, database: DataFrame, tree: DataFrame, seed: Seed, read: str = "id", mates: str | None = None) -> DataFrame:
    """read, taxon, len, kmers, hits, missing, ambig of every read (read, seq); rows of equal id are mates of one read.

    ambig counts places whose k-mer has an ambiguous letter: each mate's places less its hits and missing k-mers.
    """
    plain = Seed(seed.k, 0, seed.gaps, seed.canonical, seed.alphabet)
    places = F.greatest(F.length("seq") - (plain.span - 1), F.lit(0))
    totals = reads.groupBy(read).agg(F.sum(F.coalesce(places, F.lit(0))).cast("long").alias("_places"), F.sum(F.coalesce(F.length("seq"), F.lit(0))).cast("long").alias("len"))
    # k-mers of a read are folded where they are made; its parts, if it has mates, are added after the lookup
    found = parts(reads, plain, [read], "seq").join(database, "kmer", "left")
    paths = tree.select("taxid", "path")
    by_taxon = found.groupBy(read, "taxid").agg(F.sum("n").alias("n")).join(paths, "taxid", "left")
    rows = by_taxon.groupBy(read).agg(
        F.collect_list(F.when(F.col("taxid").isNotNull(), F.struct("taxid", "n", "path"))).alias("_hits"),
        F.sum(F.when(F.col("taxid").isNotNull(), F.col("n"))).alias("hits"), F.sum(F.when(F.col("taxid").isNull(), F.col("n"))).alias("missing"),
    )
    rows = rows.select(read, resolve(F.col("_hits")).alias("taxon"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "missing")])
    out = totals.join(rows, read, "left").na.fill(0, ["taxon", "hits", "missing"])
    return out.select(read, "taxon", "len", (F.col("hits") + F.col("missing")).alias("kmers"), "hits", "missing", (F.col("_places") - F.col("hits") - F.col("missing")).alias("ambig"))


def taxa_runs(reads: DataFrame, database: DataFrame, seed: Seed, read: str = "id", full: bool = False, mate: str | None = None) -> DataFrame:
    """read, runs: neighbouring hits of one taxon as taxid:length, in order of place, tab-separated.

    mate: a column that orders the sequences of one read; their hits stand in one list, the second's after the first's.

    full also lists runs of missing (U) and ambiguous (A) places; else a read without hits is 0:0. Hits are shuffled and sorted
    once, by read and place; a task then holds the runs of one read.
    """
    plain = Seed(seed.k, 0, seed.gaps, seed.canonical, seed.alphabet)
    reads = reads.withColumn("_mate", F.col(mate).cast("int") if mate else F.lit(0))
    at = ["_mate", "pos"]
    found = kmers(reads, plain, [read, "_mate"], "seq").join(database, "kmer", "left").select(read, *at, F.coalesce(F.col("taxid").cast("string"), F.lit("U")).alias("sign"))
    if full:
        places = reads.filter(F.length("seq") >= plain.span).select(read, "_mate", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("seq") - plain.span).cast("long"))).alias("pos"))
        found = places.join(found, [read, *at], "left").withColumn("sign", F.coalesce("sign", F.lit("A")))
    else:
        found = found.filter("sign <> 'U'")
    in_order = found.repartition(read).sortWithinPartitions(read, *at, "sign").select(read, "sign")
    runs = in_order.mapInArrow(_runs, f"`{read}` {dict(reads.dtypes)[read]}, runs string")
    return reads.select(read).distinct().join(runs, read, "left").na.fill("0:0", ["runs"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """read, runs of rows (read, sign) that come by read and place."""
    begun, key, sign, n, texts = False, None, None, 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out = []
        for k, s, m in zip(*(c.take(pa.array(new)).to_pylist() for c in batch.columns), np.diff(np.append(new, batch.num_rows)).tolist()):
            same = begun and k == key
            if same and s == sign:  # goes on from the batch before
                n += m
                continue
            if begun:
                texts.append(f"{sign}:{n}")
            if begun and not same:
                out.append((key, "\t".join(texts)))
                texts = []
            begun, key, sign, n = True, k, s, m
        if out:
            yield _texts(out, batch.schema)
    if begun:
        yield _texts([(key, "\t".join([*texts, f"{sign}:{n}"]))], batch.schema)


def _texts(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    keys, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(texts, pa.string())], [schema.field(0).name, "runs"])


def kraken_lines(classified: DataFrame, runs: DataFrame, read: str = "id", name: str = "id", everything: bool = True, keep: bool = False) -> DataFrame:
    """value: a line per read: C or U, name, taxon, length, missing and ambiguous counts if any, runs. keep: also read."""
    both = classified.join(runs, read)
    if not everything:
        both = both.filter("taxon > 0")
    counts = [F.when(F.col(c) > 0, F.concat(F.lit(f"{sign}:"), c)) for c, sign in (("missing", "M"), ("ambig", "A"))]
    return both.select(*[read] * keep, F.concat_ws("\t", F.when(F.col("taxon") > 0, "C").otherwise("U"), F.col(name).cast("string"), F.col("taxon").cast("string"), F.col("len").cast("string"), *counts, "runs").alias("value"))


def fastq_records(reads: DataFrame, classified: DataFrame, read: str = "id", everything: bool = True, name: str | None = None, runs: DataFrame | None = None, mate: str | None = None) -> DataFrame:
    """value: FASTQ records with the classification in the comment; a read without qualities repeats its sequence.

    name: the column with the name to write, else read. runs (of taxa_runs) go to the end of the comment. mate: the mates of a
    read become neighbouring records, both with its comment.
    """
    both = reads.join(classified, read)
    if runs is not None:
        both = both.join(runs, read)
    if not everything:
        both = both.filter("taxon > 0")
    quality = F.coalesce(F.col("qual"), F.col("seq")) if "qual" in reads.columns else F.col("seq")
    counts = [F.when(F.col(c) > 0, F.concat(F.lit(f"{sign}:"), c)) for c, sign in (("missing", "M"), ("ambig", "A"))]
    more = ["runs"] if runs is not None else []
    comment = F.concat_ws("\t", F.when(F.col("taxon") > 0, "C").otherwise("U"), F.col("taxon").cast("string"), F.col("len").cast("string"), *counts, *more)
    head = F.concat(F.lit("@"), F.col(name or read).cast("string"), F.lit(" "), comment)
    record = F.concat_ws("\n", head, "seq", F.lit("+"), quality)
    if not mate:
        return both.select(read, record.alias("value"))
    in_order = F.sort_array(F.collect_list(F.struct(F.col(mate).alias("m"), record.alias("r"))))
    return both.groupBy(read).agg(F.array_join(F.transform(in_order, lambda x: x["r"]), "\n").alias("value"))


def summary(classified: DataFrame) -> DataFrame:
    """classified, n."""
    return classified.groupBy((F.col("taxon") > 0).alias("classified")).agg(F.count(F.lit(1)).alias("n"))
