"""What the operators share: written tables, size-checked joins, ranks without one large task, rows dropped in place."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, drop, join_checked, written  # noqa: F401

#: The six ASCII white-space characters that separate words, and the upper-case letters that are lowered.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A key is hot if it has at least one in so many of the rows, so there are at most so many hot keys.
HOT_SHARE = 1_000
#: Bytes of one Arrow batch; keeps a worker's memory bounded however long the texts are.
BATCH_BYTES = 8 << 20
#: Fixed value: rows that one of Spark's bitmaps covers; a bitmap has an eighth of that in bytes.
BITMAP_ROWS = 1 << 15


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of the batches that go to Python workers. The setting is read when a plan is made, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def map_arrow(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def fresh(taken: Iterable[str], *bases: str) -> list[str]:
    """A column name for each base that none of the taken names equals, whatever their case."""
    low = {c.lower() for c in taken}
    out = []
    for name in bases:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def join_groups(left: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """left joined to one row per group, of a few numbers or digests; n counts the group's rows in left.

    Groups with a thousandth of all rows or more are at most a thousand, so they are broadcast and their rows
    stay where they are; only the rest is shuffled, and no key of it is hot. Both should be written tables.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    least = max(2, -(-total // HOT_SHARE))
    hot = groups.filter(F.col(n) >= least)
    stay = left.join(F.broadcast(hot), key)
    move = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(n) < least), key)
    return stay.unionByName(move)


def gapless(df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """Adds `to`, the rank from 0 of each row in its group by (bucket, order), without a window over a whole group.

    Rows are ranked inside (group, bucket); the counts of the buckets, one row each, give each bucket's offset.
    The order must tell rows apart up to repeated rows, which are interchangeable. df is read twice, so it should be
    a written table or cheap to make again. Any other columns are carried along, whatever their names.
    """
    both = [*group, *bucket]
    n, ahead, place, *keys = fresh([*df.columns, to], "n", "ahead", "place", *[f"key{i}" for i in range(len(both))])
    counts = df.groupBy(*both).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(k) for c, k in zip(both, keys)], F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*both).orderBy(*order)) - 1)
    joined = ranked.join(offsets, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(both, keys)])
    return joined.withColumn(to, (F.col(ahead) + F.col(place)).cast("long")).drop(ahead, place, *keys)


def buckets_for(df: DataFrame, rows: int) -> int:
    """Into how many parts, a power of two, a group of so many rows is split for windows: a few for each shuffle task at most."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(max(1, rows // 64), max(4 * tasks, rows // 20_000))
    return 1 << (wanted - 1).bit_length()


class Located:
    """Documents of which every row can be told apart, and dropped, where it is read.

    A row is known by a hash of its file's path and its place in that file, which each scan of the file gives again. So a
    verdict is a pair of numbers, and the texts are never shuffled to meet it. What is no plain scan of Parquet files is
    written as one first.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        if not _plain_scan(docs):
            docs = written(docs, "located")
        self.file, self.place = fresh(docs.columns, "at_file", "at_place")
        meta = docs.metadataColumn("_metadata")
        self.path = meta["file_path"]
        self.docs = docs
        self.rows = docs.select("*", F.xxhash64(self.path).alias(self.file), meta["row_index"].alias(self.place))

    def select(self, **columns: Column) -> DataFrame:
        """The named columns of every row, then at_file and at_place."""
        return self.rows.select(*[c.alias(n) for n, c in columns.items()], F.col(self.file).alias("at_file"), F.col(self.place).alias("at_place"))

    def keep(self, verdict: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
        """The documents without the rows that verdict (at_file, at_place, kept) drops, columns as they were.

        Dropped rows become a bitmap for each 32,768 rows of a file. They are broadcast: all at once if they have at most
        `most` bytes, else for one group of files after the other, each with a scan of its own.
        """
        at = F.col("at_place") + 1
        gone = verdict.filter("NOT kept").groupBy("at_file", F.bitmap_bucket_number(at).alias("at_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("at_bits"))
        gone = written(gone, "dropped")
        groups = -(-gone.count() * (BITMAP_ROWS // 8 + 64) // most)
        if groups <= 1:
            return self._without(self.rows, gone)
        out = None
        for i in range(groups):  # a filter on the path alone: other groups' files are not opened
            part = self._without(self.rows.filter(F.pmod(F.xxhash64(self.path), F.lit(groups)) == i), gone.filter(F.pmod("at_file", F.lit(groups)) == i))
            out = part if out is None else out.unionByName(part)
        return out

    def _without(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        names = fresh(rows.columns, "file", "bucket", "bits")
        maps = F.broadcast(gone.select(*[F.col(c).alias(n) for c, n in zip(("at_file", "at_bucket", "at_bits"), names)]))
        at = F.col(self.place) + 1
        bit = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(names[2], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        dropped = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
        both = rows.join(maps, (F.col(self.file) == F.col(names[0])) & (F.bitmap_bucket_number(at) == F.col(names[1])), "left")
        return both.filter(~dropped).select(*[rows[c] for c in self.columns])


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs is all rows of Parquet files, which have row numbers."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  analysed here
    except AnalysisException:
        return False
    return docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
