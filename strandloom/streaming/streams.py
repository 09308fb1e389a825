"""Streams: classify reads as they arrive, count events and k-mers in windows of event time, keep running profiles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.specs import Seed
from ..operators.classify import classify
from ..operators.kmers import kmers
from ..storage import new_path, scope


def classify_stream(reads: DataFrame, database: DataFrame, tree: DataFrame, seed: Seed, sink: Callable[[DataFrame, int], None], checkpoint: str, read: str = "id"):
    """Starts a query that classifies every micro-batch of reads (read, seq) against a static database.

    A read's result depends on no other read, so there is no state; sink gets (classified, batch id), reads it at once, and should
    be idempotent by batch id. With a database that is bucketed by k-mer a batch shuffles its own k-mers alone.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scope():
            sink(classify(batch, database, tree, seed, read), number)

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, keys: list[str], time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, keys, n: tumbling or sliding counts; rows later than `late` behind the newest are not counted."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def windowed_kmers(reads: DataFrame, seed: Seed, time: str = "ts", seq: str = "seq", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, kmer, n: k-mers of reads (seq, time) in windows of event time."""
    found = kmers(reads.withWatermark(time, late), seed, [time], seq)
    return found.groupBy(F.window(time, width).alias("w"), "kmer").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kmer", "n")


PROFILE = "key string, reads long, bases long, gc long"


def running_profile(reads: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """key, reads, bases, gc: totals so far of each key that a micro-batch has reads of (update mode). Kept as state per key.

    Batches are summed before they meet the state, so a key's rows in a batch are as many as its input partitions at most.
    """
    letters = F.upper(seq)
    each = reads.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.length(seq).cast("long").alias("bases"), (F.length(letters) - F.length(F.translate(letters, "GC", ""))).cast("long").alias("gc"))

    def folded(batches):
        for batch in batches:
            sums = batch.groupby("key", dropna=False).agg(reads=("bases", "size"), bases=("bases", "sum"), gc=("gc", "sum")).reset_index()
            yield sums[["key", "reads", "bases", "gc"]]

    def update(group, parts, state: GroupState):
        now = state.get if state.exists else (0, 0, 0)
        for part in parts:
            now = tuple(int(a + part[c].sum()) for a, c in zip(now, ("reads", "bases", "gc")))
        state.update(now)
        yield pd.DataFrame([(group[0], *now)], columns=["key", "reads", "bases", "gc"])

    return each.na.fill(0).mapInPandas(folded, PROFILE).groupBy("key").applyInPandasWithState(update, PROFILE, "reads long, bases long, gc long", "update", GroupStateTimeout.NoTimeout)


def session_counts(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n."""
    rows = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end and returns what it wrote (append mode: a written table)."""
    spark = stream.sparkSession
    place = new_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
