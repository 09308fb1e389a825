"""Tables that end a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = ""
#: Tables that are still there, with the session that wrote them.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder, in local mode only."""
    global _OWN
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    _OWN = _OWN or tempfile.mkdtemp(prefix="strandloom-")
    return _OWN


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, swept with the written tables."""
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def written(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, lost executors cost nothing but a reread.

    instead: a written table that nothing but df reads; it goes once df is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    if instead is not None:
        drop(instead)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no plan will read again."""
    for df in tables:
        path = getattr(df, "_strandloom_path", None)
        if path in _WRITTEN:
            _delete(path)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables written in it: for jobs whose result has then been written elsewhere or collected."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _delete(path)


def _delete(path: str) -> None:
    """By the session's file system; a local folder also without a session, which may have ended before."""
    spark = _WRITTEN.pop(path)
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        shutil.rmtree(unquote(parts.path) if parts.scheme else path, ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the gateway of a remote file system has ended; its folder goes with the cluster
            continue
    if _OWN:
        shutil.rmtree(_OWN, ignore_errors=True)


#: A table of at most so many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table, held in memory, has at most `most` bytes: 16 for each value and row, and what is long its own."""
    long = [F.coalesce(F.sum(F.octet_length(c) if kind in ("string", "binary") else 16 * F.size(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith("array")]
    n, *more = df.agg(F.count(F.lit(1)), *long).first()
    return 16 * n * (1 + len(df.columns)) + sum(more) <= most


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """left joined to a table of ids or numbers: by broadcast if right has at most `most` bytes, else by shuffle.

    right should be a written table, since it is measured first.
    """
    return left.join(F.broadcast(right) if fits(right, most) else right.hint("shuffle_merge"), on, how)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table that Spark may broadcast by its files' size, unless it has more than `most` bytes in memory."""
    return df if fits(df, most) else df.hint("shuffle_merge")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its scan has far fewer parts, as a small file with one row group has; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
