"""Exact dedup by content-defined chunk recipes.

A text's bytes are cut where a hash of the last eight bytes says so, which depends on content alone. Chunks are
deduplicated to identifiers that are verified: every distinct chunk is moved once, beside its digest, and if two
contents ever share a digest the digests are made anew with another key until none do. A document is then the ordered
list of its chunks' identifiers (its recipe), and documents are equal if their recipes are: the texts themselves, long
ones above all, are never shuffled or compared.

Defined results. Texts are equal if identical after lower-casing A-Z. Null text is an empty text. Of equal texts the
row with the largest doc_id stays (null below all); of rows that repeat that doc_id too, one. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, Located, join_groups, map_arrow, written

#: Least and most bytes of a chunk; beyond the least, one position in MEAN cuts.
LEAST, MOST, MEAN = 512, 16_384, 1_024
#: Keys that are tried until no two contents share a digest.
KEYS = 9
#: Fixed value: an odd 64-bit multiplier (the golden ratio) that mixes eight bytes.
MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data; none for empty data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    windows = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    marks = np.flatnonzero((windows * MIX) >> np.uint64(54) == 0) + 8  # 10 bits: one in MEAN
    ends, start, at = [], 0, 0
    while n - start > LEAST:
        at = int(np.searchsorted(marks, start + LEAST))
        end = min(int(marks[at]) if at < len(marks) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def normal_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""


def digest(chunk: bytes, key: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16, salt=key.to_bytes(4, "little")).digest()


def recipes(texts: DataFrame, key: int = 0, digest: Callable[[bytes, int], bytes] = digest) -> DataFrame:
    """texts (doc_id, text, at_file, at_place) with text_sha256 and recipe, the digests of its chunks in order, instead of text."""

    def kernel(batches):
        for batch in batches:
            hexes, lists = [], []
            for text in batch.column(1).to_pylist():
                data = normal_bytes(text)
                hexes.append(hashlib.sha256(data).hexdigest())
                ends = cuts(data)
                lists.append(b"".join(digest(data[i:j], key) for i, j in zip([0, *ends], ends)))
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(hexes, pa.string()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at_file", "at_place", "text_sha256", "recipe"])

    return map_arrow(texts, kernel, "doc_id long, at_file long, at_place long, text_sha256 string, recipe binary")


def clashes(texts: DataFrame, key: int = 0, digest: Callable[[bytes, int], bytes] = digest) -> int:
    """How many digests stand for more than one content. A chunk leaves a worker's batch once and is shuffled once."""

    def kernel(batches):
        for batch in batches:
            met: dict[tuple[bytes, bytes], None] = {}
            for text in batch.column(0).to_pylist():
                data = normal_bytes(text)
                ends = cuts(data)
                for i, j in zip([0, *ends], ends):
                    chunk = data[i:j]
                    met[digest(chunk, key), chunk] = None
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in met], pa.binary()), pa.array([c for _, c in met], pa.binary())], ["digest", "chunk"])

    chunks = map_arrow(texts.select("text"), kernel, "digest binary, chunk binary").distinct()
    return chunks.groupBy("digest").count().filter("count > 1").count()


def verdicts(texts: DataFrame, digest: Callable[[bytes, int], bytes] = digest) -> DataFrame:
    """doc_id, at_file, at_place, keep_id, group_size, kept, text_sha256 of every row of texts (doc_id, text, at_file, at_place)."""
    for key in range(KEYS):
        if not clashes(texts, key, digest):
            break
    else:
        raise RuntimeError(f"digests of chunks clash under each of {KEYS} keys")
    rows = written(recipes(texts, key, digest), "recipes")
    for key in range(KEYS):
        # A recipe may be long, so rows meet by its digest, which the distinct recipes verify.
        named = rows.withColumn("group", F.sha2(F.concat(F.lit(f"{key}:").cast("binary"), "recipe"), 256))
        best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("top"), "at_file", "at_place"))
        groups = named.groupBy("group", "recipe").agg(best.alias("best"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = written(groups.select("group", "keep_id", "group_size", F.col("best.at_file").alias("keep_file"), F.col("best.at_place").alias("keep_place")), "groups")
        n, kinds = groups.agg(F.count(F.lit(1)), F.count_distinct("group")).first()
        if n == kinds:
            break
    else:
        raise RuntimeError(f"digests of recipes clash under each of {KEYS} keys")
    kept = (F.col("at_file") == F.col("keep_file")) & (F.col("at_place") == F.col("keep_place"))
    return join_groups(named.drop("recipe"), groups, "group", "group_size").select("doc_id", "at_file", "at_place", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return verdicts(Located(docs).select(doc_id=F.col(id_col).cast("long"), text=F.col(text_col))).drop("at_file", "at_place")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, columns as they were."""
    at = Located(docs)
    return at.keep(verdicts(at.select(doc_id=F.col(id_col).cast("long"), text=F.col(text_col))))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""
