"""Best-fit packing with large-item matching.

A document's ids, ended by the end id, are cut only if longer than a sequence. Which pieces meet in a sequence depends
on their lengths alone, so the plan is made on the histogram of lengths: at most as many rows as a sequence has tokens,
whatever the corpus. Pieces over a third of the capacity fit at most twice: the longest takes the longest that fits
beside it. The shorter ones, longest first, go where they leave the smallest gap. The plan is a list of runs (so many
sequences take so many pieces of this length from this rank on, at this offset); a piece finds its run by its rank
among the pieces of its length.

Defined results. Null or empty text: one piece, the end id alone. Very long texts: as many full pieces as needed. Equal
lengths: any order. Repeated rows and null doc_id: pieces of their own. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, gapless, map_arrow, written
from .vocab import WORDWISE, by_bytes, encode, fold_texts

CAPACITY, END_ID, BATCH_BYTES = 4096, 1, 1 << 20


def packed_ids(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    out: list[bytes] = []
    for batch in by_bytes(texts, BATCH_BYTES):
        out += fold_texts(batch, path, "ids") if path.endswith(WORDWISE) else [np.array(x, "<u4").tobytes() for x in encode(path, batch)]
    return out


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with_ids adds its packed ids."""
    end = end_id.to_bytes(4, "little")

    def kernel(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, ids in enumerate(packed_ids(batch.column(1).to_pylist(), path)):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[start : start + 4 * capacity]
                    for x, v in zip(rows, (at, k, start // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]] + ([pa.array(rows[5], pa.binary())] if with_ids else []),
                ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
            )

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), kernel, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, sequences, pieces in each, first sequence, offset) that place every piece once."""
    left = {length: n for length, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    open_gaps: list[int] = []  # in order
    bins = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, each, first, offset))
        used[length] += n * each
        left[length] -= n * each

    large = sorted((x for x in left if 3 * x > capacity))
    while large:
        length = large[-1]
        fits = bisect_left(large, capacity - length + 1) - 1
        mate = large[fits] if fits >= 0 else 0
        if mate == length and left[length] == 1:
            mate = large[fits - 1] if fits > 0 else 0
        n = left[length] if not mate else left[length] // 2 if mate == length else min(left[length], left[mate])
        if mate == length:
            put(length, n, 2, bins, 0)
        else:
            put(length, n, 1, bins, 0)
            if mate:
                put(mate, n, 1, bins, length)
        leave(capacity - length - mate, bins, n)
        bins += n
        large = [x for x in large if left[x]]
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while (n := left[length]) > 0:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                new = -(-n // each)
                leave(capacity, bins, new)
                bins += new
                continue
            gap = open_gaps[at]
            first, there = gaps[gap].pop()
            if not gaps[gap]:
                del open_gaps[at]
            each = gap // length
            full = min(there, n // each)
            if full:
                put(length, full, each, first, capacity - gap)
                leave(gap - each * length, first, full)
            rest = n - full * each
            if full < there and rest:
                put(length, 1, rest, first + full, capacity - gap)
                leave(gap - rest * length, first + full, 1)
                full += 1
            leave(gap, first + full, there - full)
    return runs


def place(ranked: DataFrame, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Adds sequence_id and offset to pieces with length and rank. The runs' number follows the capacity, not the corpus."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]
    names = ranked.columns

    def kernel(batches):
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            local = rank - run[:, 1]
            out = [pa.array(run[:, 4] + local // run[:, 3]), pa.array(run[:, 5] + local % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*names, "sequence_id", "offset"])

    return map_arrow(ranked, kernel, ", ".join(f"{c} {t}" for c, t in ranked.dtypes) + ", sequence_id long, offset long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table with doc_id, piece, length, ids_crc32) with sequence_id and offset, gapless from 0."""
    counts = {length: n for length, n in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # in order of a hash, whose first bits are the bucket: the ranks do not depend on how many buckets there are
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32"), 1)
    bits = buckets_for(parts, sum(counts.values())).bit_length() - 1
    keyed = parts.withColumns({"_key": key, "_sub": F.shiftrightunsigned(key, 63 - bits) if bits else F.lit(0).cast("long")})
    ranked = gapless(keyed, ["length"], ["_sub"], ["_key", "doc_id", "piece", "ids_crc32"], "rank").drop("_key", "_sub")
    return place(ranked, plan(counts, capacity)).drop("rank")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))
