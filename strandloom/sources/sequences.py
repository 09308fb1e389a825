"""FASTA and FASTQ, plain or compressed, as DataFrames (path, rec_no, name, comment, seq, qual)."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

SCHEMA = "path string, rec_no long, name string, comment string, seq string, qual string"


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA, plain, .gz or .bz2, split by Spark at records: large plain files are read by many tasks. No rec_no, no qual."""
    rows = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>", "").alias("r"))
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", "")
    rows = rows.filter(F.length(F.trim("r")) > 0)
    return rows.select("path", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.regexp_replace(head, r"^\S*\s*|\s+$", ""), F.lit("")).alias("comment"), body.alias("seq"))


def _opened(path: str, data: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(data)
    if path.endswith(".gz"):
        return gzip.open(raw)
    if path.endswith(".bz2"):
        return bz2.open(raw)
    if path.endswith(".xz"):
        return lzma.open(raw)
    if path.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return raw


def parse(lines: Iterator[str]) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, sequence, quality) of FASTA or FASTQ records; both may span lines. A record that ends early has no quality."""
    line = next(lines, None)
    while line is not None:
        if not line or line[0] not in ">@":
            line = next(lines, None)
            continue
        name, _, comment = line[1:].partition(" ") if " " in line else line[1:].partition("\t")
        parts = []
        while (line := next(lines, None)) is not None and (not line or line[0] not in ">@+"):
            parts.append(line.strip())
        seq, qual = "".join(parts), None
        if line is not None and line.startswith("+"):
            got: list[str] = []
            have = 0
            while have < len(seq) and (line := next(lines, None)) is not None:
                got.append(line)
                have += len(line)
            qual = "".join(got) if have == len(seq) else None
            line = next(lines, None)
        yield name, comment.strip() or None, seq, qual


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA or FASTQ, plain, .gz, .bz2, .xz or .zst, with record numbers and qualities; a task reads whole files."""

    def kernel(batches):
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                held = 0
                text = io.TextIOWrapper(_opened(p, data), encoding="latin-1", newline=None)
                for i, (name, comment, seq, qual) in enumerate(parse(x.rstrip("\n") for x in text)):
                    rows.append((p, i, name, comment, seq, qual))
                    held += 2 * len(seq)
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(kernel, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["path", "rec_no", "name", "comment", "seq", "qual"])


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTQ of four lines a record: (path, block, at, name, comment, seq, qual), read in pieces by many tasks.

    Spark splits plain and .bz2 files at lines; a task parses its piece and hands on the lines before its first record and
    after its last one, which meet those of its neighbours in one row per file. block and at give records their order. A
    compressed file that can't be split is streamed by one task. A record that ends early has no quality.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    whole = written(lines.mapInArrow(_fastq_pieces, PIECES), "fastq")
    ends = whole.filter("name IS NULL").groupBy("path").applyInArrow(_fastq_ends, PIECES)
    return whole.filter("name IS NOT NULL").unionByName(ends).select("path", "block", "at", "name", "comment", "seq", "qual")


PIECES = "path string, block long, at long, name string, comment string, seq string, qual string, lines array<string>"
_PIECES = pa.schema([(n, pa.list_(pa.string()) if n == "lines" else pa.int64() if n in ("block", "at") else pa.string()) for n in (x.split()[0] for x in PIECES.split(", "))])


_LOOSE = 1 << 40  # more than the records of a piece


def _record(path: str, block: int, at: int, four: list[str]) -> tuple:
    name, _, comment = four[0][1:].replace("\t", " ").partition(" ")
    seq = four[1].strip() if len(four) > 1 else ""
    qual = four[3].strip() if len(four) > 3 else None
    return path, block, at, name, comment.strip() or None, seq, qual if qual is not None and len(qual) == len(seq) else None, None


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


def _fastq_pieces(batches):
    """Records of each piece, and two rows of loose lines, placed before its first record and after its last."""
    key, head, begun, held, n = None, [], False, [], 0
    rows: list[tuple] = []

    def over():
        return [(*key, -_LOOSE, None, None, None, None, head), (*key, _LOOSE, None, None, None, None, held)] if key else []

    for batch in batches:
        for path, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, block) != key:
                rows += over()
                key, head, begun, held, n = (path, block), [], False, [], 0
            held.append(line.rstrip("\r"))
            if not begun:  # a record begins where a line with @ stands two before one with +
                begun = len(held) > 2 and held[-3].startswith("@") and held[-1].startswith("+")
                if begun:
                    head, held = held[:-3], held[-3:]
            elif len(held) == 4:
                rows.append(_record(*key, n, held))
                held, n = [], n + 1
        if len(rows) > 4096:
            yield _pieces(rows)
            rows = []
    if not begun and key:
        head, held = held, []
    rows += over()
    if rows:
        yield _pieces(rows)


def _fastq_ends(table: pa.Table) -> pa.Table:
    """The records that stand in two pieces or more of a file: the loose lines in order."""
    rows = sorted((r["block"], r["at"], r["path"], r["lines"] or []) for r in table.to_pylist())
    out, held, place = [], [], None
    for block, at, path, lines in rows:
        for i, line in enumerate(lines):
            place = place or (path, block, at + i)
            held.append(line)
            if len(held) == 4:
                out.append(_record(*place, held))
                held, place = [], None
    if held and any(x.strip() for x in held):
        out.append(_record(*place, held))
    return pa.Table.from_batches([_pieces(out)]) if out else _PIECES.empty_table()


def numbered_reads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """read_sequences() with file_no, the place of a record's file among the paths in the order given (those of a pattern by name)."""
    rows = None
    ahead = 0
    for one in [paths] if isinstance(paths, str) else paths:
        names = sorted(r.path for r in spark.read.format("binaryFile").load(one).select("path").collect())  # paths, no contents
        table = spark.createDataFrame([(n, ahead + i) for i, n in enumerate(names)], "path string, file_no long")
        some = read_sequences(spark, one).join(F.broadcast(table), "path")
        rows = some if rows is None else rows.unionByName(some)
        ahead += len(names)
    return rows


def read_id(file_no, rec_no):
    """One number for a record: 2**40 records a file."""
    return F.shiftleft(file_no.cast("long"), 40) + rec_no


def pair(first: DataFrame, second: DataFrame) -> DataFrame:
    """read_id, mate, name, comment, seq, qual of two lists of files (file_no, rec_no, ...): the n-th files belong together, and
    in these the records by number. A record without a mate goes; unpaired() counts them."""
    key = ["file_no", "rec_no"]
    both = first.select(*key).join(second.select(*key), key)
    rows = None
    for mate, df in ((1, first), (2, second)):
        one = df.join(both, key, "left_semi").select(read_id(F.col("file_no"), F.col("rec_no")).alias("read_id"), F.lit(mate).cast("tinyint").alias("mate"), trim_mate(F.col("name")).alias("name"), "comment", "seq", "qual")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def unpaired(first: DataFrame, second: DataFrame) -> int:
    """How many records of either side have no mate."""
    key = ["file_no", "rec_no"]
    sides = [x.select(*key, F.lit(i).alias("a"), F.lit(1 - i).alias("b")) for i, x in ((1, first), (0, second))]
    return sides[0].unionByName(sides[1]).groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> b").count()


def trim_mate(name):
    return F.regexp_replace(name, "/[0-9]$", "")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 70) -> None:
    body = F.trim(F.regexp_replace(F.col(seq), f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else F.col(seq)
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), body)).write.mode("overwrite").text(path)


def write_fastq(df: DataFrame, path: str, name: str = "name", seq: str = "seq", qual: str | None = None, order: str | list[str] | None = None) -> None:
    """A folder of FASTQ files; with order, one file in that order. Without qualities each letter has the best usual one."""
    quality = F.col(qual) if qual else F.repeat(F.lit("I"), F.length(seq))
    rows = (df.coalesce(1).sortWithinPartitions(order) if order else df).select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(name).cast("string")), seq, F.lit("+"), quality))
    rows.write.mode("overwrite").text(path)


def synthetic(spark: SparkSession, depth: int = 4, split: int = 3, length: int = 1000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(tree, genomes): a full tree of taxa, and for each leaf a genome of one random segment per node on its path."""
    n = sum(split**d for d in range(depth))
    tree = spark.range(1, n + 1).select(F.col("id").alias("taxid"), F.when(F.col("id") == 1, 0).otherwise(F.floor((F.col("id") - 2) / split) + 1).cast("long").alias("parent"))
    first = n - split ** (depth - 1) + 1
    path = F.col("id")
    steps = [path]
    for _ in range(depth - 1):
        steps.append(F.when(steps[-1] > 1, F.floor((steps[-1] - 2) / split) + 1))
    digit = lambda node, i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), node.cast("string"), i.cast("string")).cast("binary")), 1, 1), 16, 10).cast("int")
    base = lambda node, i: F.substring(F.lit("ACGT"), digit(node, i) % 4 + 1, F.lit(1))
    segment = lambda node: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: base(node, i)), "")
    leaves = spark.range(first, n + 1)
    return tree, leaves.select(F.col("id").alias("taxid"), F.concat(*[segment(s.cast("long")) for s in reversed(steps)]).alias("seq"))
