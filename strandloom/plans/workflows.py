"""Whole jobs: from files to a database, from a database and reads to lines, counts, sketches, and new taxa."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.specs import Seed, parse_spacing
from ..operators import classify as C
from ..operators import database as D
from ..operators import kmers as K
from ..operators import metatree as M
from ..operators import sets as A
from ..operators import similarity as U
from ..operators import taxonomy as T
from ..sources import sequences, tables
from ..storage import bounded, drop, new_path, written


def seed_of(k: int = 31, w: int = 0, spacing: str = "", canonical: bool = True) -> Seed:
    """k = 31, no window and both strands alike, unless told otherwise."""
    return Seed(k, max(w, 0), parse_spacing(spacing, k) if spacing else (), canonical)


def genomes_from_files(spark: SparkSession, paths, names: DataFrame) -> DataFrame:
    """genome, taxid, seq: every record of the files, its taxid by its header's name (the root if unknown)."""
    rows = sequences.read_sequences(spark, paths)
    return tables.with_taxid(rows.withColumn("name", tables.header_name(F.concat_ws(" ", "name", "comment"))), names).select(F.col("path").alias("genome"), "taxid", "seq")


def build_database(spark: SparkSession, paths, nodes_path: str, names_path: str, to: str, mode: str = "lex", **seed) -> DataFrame:
    """Reads genomes and taxonomy, builds a database by `mode`, saves it at `to`, and returns it as read from there."""
    one = seed_of(**seed)
    tree = T.nodes(tables.read_taxonomy(spark, nodes_path))
    D.save(D.build(genomes_from_files(spark, paths, tables.read_names(spark, names_path)), one, tree, mode), one, to)
    return D.load(spark, to)[0]


def classify_files(spark: SparkSession, first, database_path: str, nodes_path: str, second=None, everything: bool = True, fastq: bool = False, runs: bool = True) -> DataFrame:
    """id, value for the reads of some files, or of two lists of files whose n-th ones hold mates: lines, or FASTQ records.

    id is the read's number in the order of files and records; runs puts the taxa's runs behind a FASTQ record's comment too.
    """
    database, seed = D.load(spark, database_path)
    database = bounded(database)
    tree = T.nodes(tables.read_taxonomy(spark, nodes_path))
    one = sequences.numbered_reads(spark, first)
    if second:  # read once, for the count of lost mates and for the pairs
        one, two = written(one, "first"), written(sequences.numbered_reads(spark, second), "second")
        if lost := sequences.unpaired(one, two):
            warnings.warn(f"{lost} records have no mate and are left out", stacklevel=2)
        rows = sequences.pair(one, two).withColumnRenamed("read_id", "id")
    else:
        rows = one.select(sequences.read_id(F.col("file_no"), F.col("rec_no")).alias("id"), F.lit(1).cast("tinyint").alias("mate"), sequences.trim_mate(F.col("name")).alias("name"), "comment", "seq", "qual")
    rows = bounded(written(rows, "reads"))
    if second:
        drop(one, two)
    found = bounded(written(C.classify(rows, database, tree, seed), "classified"))
    listed = C.taxa_runs(rows, database, seed, mate="mate") if runs or not fastq else None
    if fastq:
        return C.fastq_records(rows, found, "id", everything, "name", listed, "mate")
    named = rows.filter("mate = 1").select("id", "name")
    return C.kraken_lines(found.join(named, "id"), listed, "id", "name", everything, keep=True)


def count_kmers(spark: SparkSession, paths, k: int = 31, canonical: bool = True, to: str | None = None, form: str = "tsv") -> DataFrame:
    """kmer, n of all records, most frequent first; k over 31 is counted by rolling hash. to, form: local files of stream_counts()."""
    rows = sequences.read_sequences(spark, paths)
    if k <= 31:
        found = A.kmer_counts(rows, seed_of(k, canonical=canonical))
    else:
        found = K.rolling(rows.select(F.lit(0).alias("id"), "seq"), k, 0, ["id"], family=_family(canonical)).groupBy(F.col("hash").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    out = found.orderBy(F.desc("n"), "kmer")
    if to:
        tables.stream_counts(written(out, "counts"), to, form)
    return out


def _family(canonical: bool) -> str:
    return "strand_free" if canonical else "cyclic"


def index_positions(spark: SparkSession, paths, to: str, k: int = 31, canonical: bool = True) -> None:
    """A positional index of the files' records with their names, comments and lengths, saved at `to`."""
    rows = written(tables.numbered(sequences.numbered_reads(spark, paths).withColumn("at", sequences.read_id(F.col("file_no"), F.col("rec_no"))), "at", "ref"), "records")
    refs = rows.select("ref", "name", "comment", F.length("seq").alias("len"))
    tables.save_index(A.postings(rows, seed_of(k, canonical=canonical), "ref"), refs, {"k": k, "canonical": canonical, "kind": "positions"}, to)


def index_references(spark: SparkSession, paths, to: str, k: int = 31, canonical: bool = True) -> None:
    """An inverted index of files (k-mer to the numbers of the files that hold it), with their paths and lengths, saved at `to`."""
    rows = written(sequences.numbered_reads(spark, paths).withColumnRenamed("file_no", "ref"), "records")
    refs = rows.groupBy("ref").agg(F.first("path").alias("name"), F.lit(None).cast("string").alias("comment"), F.sum(F.length("seq")).alias("len"))
    held = K.parts(rows, seed_of(k, canonical=canonical), ["ref"]).groupBy("kmer").agg(F.sort_array(F.collect_set("ref")).alias("ids"))
    tables.save_index(held, refs, {"k": k, "canonical": canonical, "kind": "references"}, to)


def screen_files(spark: SparkSession, paths, index_path: str) -> DataFrame:
    """path, name, hits, share: how many of a reference's k-mers each file has, and the share of the file's k-mers that are."""
    index, refs, facts = tables.load_index(spark, index_path)
    mine = written(A.distinct_sets(sequences.read_sequences(spark, paths), seed_of(facts["k"], canonical=facts["canonical"]), ["path"]), "sets")
    size = mine.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    hits = mine.join(index, "kmer").select("path", F.explode("ids").alias("ref")).groupBy("path", "ref").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(refs, "ref").join(size, "path").select("path", "name", "hits", (F.col("hits") / F.col("size")).alias("share"))


def from_fasta_rolling(spark: SparkSession, paths, ks: list[int], w: int = 0, canonical: bool = True) -> DataFrame:
    """path, rec_no, k, pos, hash of every record: rolling hashes for several k of any length."""
    return K.rolling_set(sequences.read_sequences(spark, paths), ks, w, ["path", "rec_no"], family=_family(canonical))


def by_record(spark: SparkSession, paths, k: int = 31, spacing: str = "", w: int = 0, canonical: bool = True, rolling: bool = False) -> DataFrame:
    """path, rec_no, name, kmers: each record's k-mers (or rolling hashes) in order, as one array: a record is one row."""
    rows = sequences.read_sequences(spark, paths)
    found = K.rolling(rows, k, w, ["path", "rec_no"], family=_family(canonical)).withColumnRenamed("hash", "kmer") if rolling else K.kmers(rows, seed_of(k, w, spacing, canonical), ["path", "rec_no"])
    lists = found.groupBy("path", "rec_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kmer"))), lambda x: x["kmer"]).alias("kmers"))
    return rows.select("path", "rec_no", "name").join(lists, ["path", "rec_no"], "left").withColumn("kmers", F.coalesce("kmers", F.array().cast("array<long>")))


def repack(df: DataFrame, ks: tuple[int, int], kmer: str = "kmer") -> DataFrame:
    """df with k-mers of ks[0] bases cut to their first ks[1] bases."""
    long, short = ks
    if not 0 < short <= long <= 31:
        raise ValueError("k-mers are cut to fewer bases, from 31 at most")
    return df.withColumn(kmer, F.shiftrightunsigned(kmer, 2 * (long - short)))


def sketch_ks(spark: SparkSession, paths, ks: list[int], log_size: int = 14) -> DataFrame:
    """path, k, sketch: HyperLogLog sketches of rolling hashes for several k, in one pass."""
    return U.hll(from_fasta_rolling(spark, paths, ks), ["path", "k"], log_size, "hash")


def sketch_sets(spark: SparkSession, paths, size: int = 4096) -> DataFrame:
    """path, hash: bottom-k sketches of stored k-mer sets."""
    return U.bottom_k(tables.read_kmer_set(spark, paths), "path", size)


def sample_kmers(spark: SparkSession, paths, to: str, k: int = 31, size: int = 4096) -> DataFrame:
    """path, hash, kmer, n: sketches with the k-mers and counts that they stand for, saved at `to`."""
    rows = K.counted(sequences.read_sequences(spark, paths), seed_of(k), ["path"])
    tables.save_sketches(U.bottom_k_sample(rows, "path", size), "path", to)
    return tables.load_sketches(spark, to, "path")


def from_fasta(spark: SparkSession, paths, k: int = 31, spacing: str = "", w: int = 0, canonical: bool = True, unique: bool = False) -> DataFrame:
    """path, rec_no, pos, kmer of every record; unique: path, kmer, once each."""
    rows, seed = sequences.read_sequences(spark, paths), seed_of(k, w, spacing, canonical)
    return A.distinct_sets(rows, seed, ["path"]) if unique else K.kmers(rows, seed, ["path", "rec_no"])


def from_strings(spark: SparkSession, texts: list[str], k: int = 31, spacing: str = "", w: int = 0, canonical: bool = True) -> DataFrame:
    """id, pos, kmer of strings, which are numbered from 0."""
    return K.kmers(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), seed_of(k, w, spacing, canonical))


def lca_of_names(asked: DataFrame, names: DataFrame, tree: DataFrame) -> int | None:
    """Common ancestor of the taxa of names; a name that is missing is tried without its version. None if one stays unknown."""
    known = names.select(F.col("name").alias("_n"), "taxid")
    full = asked.join(known, asked["name"] == known["_n"], "left").drop("_n")
    short = full.filter("taxid IS NULL").drop("taxid").withColumn("_s", F.regexp_replace("name", r"\.[0-9]+$", ""))
    both = full.filter("taxid IS NOT NULL").select("taxid").unionByName(short.join(known, short["_s"] == known["_n"], "left").select(F.coalesce("taxid", F.lit(-1)).alias("taxid")))
    return T.lca_by(both.withColumn("k", F.lit(1)), ["k"], tree).first()["lca"]


def sketch_errors(spark: SparkSession, size: int, overlaps: list[float], log_size: int = 12) -> DataFrame:
    """i, j, exact, estimate: Jaccard of sets with given overlaps against that of their theta sketches."""
    parts = None
    for n, share in enumerate(overlaps):
        move = size - int(size * share)
        for side in (0, 1):
            one = spark.range(n * 3 * size + side * move, n * 3 * size + side * move + size).select(F.lit(f"{n}.{side}").alias("g"), F.col("id").alias("kmer"))
            parts = one if parts is None else parts.unionByName(one)
    sets = written(parts, "sets")
    exact = U.all_pairs(sets, "g").select("i", "j", F.col("jaccard").alias("exact"))
    return exact.join(U.theta_jaccard(written(U.theta(sets, ["g"], log_size), "theta"), exact, "g").withColumnRenamed("jaccard", "estimate"), ["i", "j"])


def compare_files(spark: SparkSession, paths, k: int = 31) -> DataFrame:
    """i, j, inter, uni, jaccard of the k-mer sets of files."""
    return U.all_pairs(K.parts(sequences.read_sequences(spark, paths), seed_of(k), ["path"]), "path")


def sketch_files(spark: SparkSession, paths, k: int = 31, size: int = 4096) -> DataFrame:
    """path, hash: bottom-k sketches of files."""
    return U.bottom_k(K.parts(sequences.read_sequences(spark, paths), seed_of(k), ["path"]), "path", size)


def nearest_files(spark: SparkSession, paths, k: int = 31, size: int = 4096, neighbors: int = 5) -> DataFrame:
    return U.nearest(U.bottom_k_jaccard(written(sketch_files(spark, paths, k, size), "sketches"), "path", size), neighbors)


def discover_taxa(genomes: DataFrame, tree: DataFrame, seed: Seed, most: int | None = None) -> DataFrame:
    """New nodes from the presence patterns of each parent's clades, as many as fit or as told."""
    rows = K.parts(genomes, seed, ["taxid"]).select("taxid", "kmer")
    facts = tree.agg(F.max("taxid"), F.count(F.lit(1))).first()
    return M.emit(M.node_scores(M.subtree_patterns(rows, tree, T.closure(tree))), facts[0], M.room(facts[1]) if most is None else most)


def complete(stream: DataFrame, name: str) -> DataFrame:
    """The result of an aggregated stream over a bounded input, after its last batch."""
    spark = stream.sparkSession
    place = new_path(spark, name)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")

    run = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{place}/state").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
