"""Taxonomy files, name maps, path lists, and k-mer sets, counts and samples in binary files."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and its place in the file, comments and blank lines left out."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return rows.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """taxid, parent, rank of a nodes.dmp; the root's parent is 0, the last line of a taxid counts."""
    field = lambda i: F.regexp_replace(F.element_at(F.split("value", r"\|"), i), r"^\s+|\s+$", "")
    rows = _lines(spark, path).select(field(1).cast("int").alias("taxid"), field(2).cast("int").alias("parent"), field(3).alias("rank"), "at")
    last = rows.groupBy("taxid").agg(F.max_by(F.struct("parent", "rank"), "at").alias("r"))
    found = last.filter("taxid <> 1").select("taxid", "r.parent", "r.rank")
    return found.unionByName(spark.createDataFrame([(1, 0, "root")], "taxid int, parent int, rank string"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name, taxid of a tab-separated map; the last line of a name counts."""
    part = F.split("value", "\t")
    rows = _lines(spark, path).select(part[0].alias("name"), F.trim(part[1]).cast("int").alias("taxid"), "at")
    return rows.groupBy("name").agg(F.max_by("taxid", "at").alias("taxid"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("path"))


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, None if it is empty."""
    rows = spark.read.text(path).select("value").head(1)  # lines come in order, and only the first part is read
    return rows[0][0] if rows else None


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def header_name(header):
    """A genome's name from its header line: what stands between the last two bars, else the first word."""
    return F.when(header.contains("|"), F.element_at(F.split(header, r"\|"), -2)).otherwise(F.regexp_extract(header, r"^>?(\S*)", 1))


def with_taxid(df: DataFrame, names: DataFrame, name: str = "name", missing: int = 1) -> DataFrame:
    """df with taxid by name; an unknown name gets `missing`, the root."""
    return df.join(names.select(F.col("name").alias(name), "taxid"), name, "left").withColumn("taxid", F.coalesce("taxid", F.lit(missing)))


def complete_assemblies(rows: DataFrame) -> DataFrame:
    """taxid, ftp of assembly summary lines (value) that are the latest and complete, and no contigs."""
    v = F.col("value")
    whole = v.contains("Complete Genome") | v.contains("GRCh") | v.contains("Full")
    keep = v.contains("latest") & whole & ~F.lower(v).contains("contig") & ~F.lower(v).contains("supercontig")
    part = F.split("value", "\t")
    return rows.filter(keep).select(part[5].cast("int").alias("taxid"), F.element_at(F.filter(part, lambda x: x.startswith("ftp")), -1).alias("ftp"))


def read_kmer_set(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, kmer of binary sets: the number of k-mers, then so many unsigned 64-bit words; .shs files are gzipped."""

    def kernel(batches):
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, "<u8")
                some = words[1 : 1 + int(words[0])].view(np.int64) if len(words) else words.view(np.int64)
                for at in range(0, len(some), 1 << 20):
                    part = some[at : at + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), pa.string()), pa.array(part)], ["path", "kmer"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "path string, kmer long")


def read_kmer_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, kmer, n of gzipped count maps: the number, the k-mers (64 bits each), their counts (16 bits each)."""

    def kernel(batches):
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                words, counts = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u2", n, 8 + 8 * n)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(words), pa.array(counts.astype(np.int64))], ["path", "kmer", "n"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "path string, kmer long, n long")


def read_pair_stream(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, first, second of files of 16-byte records, two unsigned 64-bit words each; a cut record at the end is left out."""

    def kernel(batches):
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(data, "<i8", 2 * (len(data) // 16)).reshape(-1, 2)
                for at in range(0, len(words), 1 << 20):
                    part = words[at : at + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), pa.string()), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["path", "first", "second"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "path string, first long, second long")


def read_similarities(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """i, j, value of a table of pairs in any order; i < j, the first of equal pairs counts."""
    rows = spark.read.csv(path, sep=sep, schema="a string, b string, value double").filter("a <> b")
    return rows.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "value").dropDuplicates(["i", "j"])


def kmer_set_bytes(words: list[int]) -> bytes:
    """A sorted set in the binary layout that read_kmer_set() reads."""
    some = np.sort(np.array(words, dtype=np.int64).view(np.uint64))
    return np.uint64(len(some)).tobytes() + some.tobytes()


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_by_k(df: DataFrame, path: str) -> None:
    """k, kmer, n as Parquet, a folder per k."""
    df.repartition("k").write.mode("overwrite").partitionBy("k").parquet(path)


def numbered(df: DataFrame, order: str, to: str = "rec_no") -> DataFrame:
    """df with record numbers from 0 in the order of a whole-number column, made inside ranges of it."""
    bucket = F.floor(F.col(order) / (1 << 20))
    rows = df.withColumn("_b", bucket)
    ahead = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return rows.withColumn("_i", inside).join(ahead, "_b").withColumn(to, F.col("_a") + F.col("_i")).drop("_b", "_i", "_a")


def save_names(names: DataFrame, path: str) -> None:
    """A name map (name, taxid) as Parquet, sorted by name so that a lookup reads few row groups."""
    names.select("name", "taxid").sortWithinPartitions("name").write.mode("overwrite").parquet(path)


def load_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_index(rows: DataFrame, references: DataFrame, facts: dict, path: str) -> None:
    """An inverted or positional index: rows (kmer and its ids or positions), references (ref, name, comment, len), and facts as JSON."""
    rows.write.mode("overwrite").parquet(f"{path}/index")
    references.write.mode("overwrite").parquet(f"{path}/references")
    rows.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(rows, references, facts) of save_index()."""
    return spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/references"), json.loads(spark.read.text(f"{path}/facts").first()[0])


def save_sketches(sketches: DataFrame, group: str, path: str) -> None:
    """Sketches (group, hash[, kmer, n]), a row per group: its hashes in order and, if there are any, the items and counts they stand for."""
    more = [c for c in ("kmer", "n") if c in sketches.columns]
    folded = sketches.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("hash", *more))).alias("s"))  # a sketch's size at most
    folded.select(F.col(group).alias("name"), *[F.col("s")[c].alias(f"{c}s") for c in ("hash", *more)]).write.mode("overwrite").parquet(path)


def load_sketches(spark: SparkSession, path: str, group: str = "name") -> DataFrame:
    rows = spark.read.parquet(path)
    names = [c for c in ("hashs", "kmers", "ns") if c in rows.columns]
    return rows.select(F.col("name").alias(group), F.explode(F.arrays_zip(*names)).alias("s")).select(group, *[F.col(f"s.{c}").alias(c[:-1]) for c in names])


def stream_lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """One local text file of a one-column table, in its order; the driver holds a part at a time."""
    with open(path, "w") as out:
        if header is not None:
            out.write(header + "\n")
        for (line,) in df.toLocalIterator(prefetchPartitions=True):
            out.write(line + "\n")


def stream_counts(counts: DataFrame, path: str, form: str = "tsv") -> list[str]:
    """k-mers and counts (kmer, n) in local files, a part at a time. Returns the files' names.

    tsv: a headed table. split: the k-mers as 64-bit words in one file, the counts in another, as wide as the largest needs.
    pairs: both as 64-bit words, side by side. set: the number of k-mers, then the sorted k-mers, gzipped. map: the number, the
    k-mers, and their counts as 16-bit words, stopped at the largest of these, gzipped.
    """
    if form == "tsv":
        stream_lines(counts.select(F.concat_ws("\t", "kmer", "n")), path, "ID\tCount")
        return [path]
    parts = lambda df: (np.array(rows, dtype=np.int64) for rows in _parts(df))
    if form == "split":
        most = counts.agg(F.max("n")).first()[0] or 0
        wide = next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(t[2]))
        with open(path + "hash", "wb") as a, open(path + "count", "wb") as b:
            for x in parts(counts.select("kmer", "n")):
                a.write(x[:, 0].astype("<i8").tobytes())
                b.write(x[:, 1].astype(wide).tobytes())
        return [path + "hash", path + "count"]
    if form == "pairs":
        with open(path, "wb") as out:
            for x in parts(counts.select("kmer", "n")):
                out.write(x.astype("<i8").tobytes())
        return [path]
    if form not in ("set", "map"):
        raise ValueError("forms: tsv, split, pairs, set, map")
    ordered = counts.orderBy((F.col("kmer") < 0).cast("int"), "kmer")  # as unsigned words
    with gzip.open(path, "wb") as out:
        out.write(np.uint64(counts.count()).tobytes())
        for x in parts(ordered.select("kmer")):
            out.write(x[:, 0].astype("<i8").tobytes())
        if form == "map":
            for x in parts(ordered.select("n")):
                out.write(np.minimum(x[:, 0], 65535).astype("<u2").tobytes())
    return [path]


def _parts(df: DataFrame, size: int = 1 << 16):
    rows = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(tuple(r))
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows
