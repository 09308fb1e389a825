"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned map deals slots to shards.

The map is the only thing that changes: rebalancing or growing edits it, a version at a time, and records keep their
slot. Bytes are summed per slot, so the driver holds one number per slot, however many records there are. The query
follows the law `bytes`: sizes near equal.

Defined results. Null text: 0 bytes, crc32 of the empty text. Null doc_id: dealt by its text. Repeated rows: the same
slot, a place each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, fresh, gapless, written

SLOTS, SHARDS, OVERHEAD = 4096, 40, 16


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, salt of every row. To be written before use: the salt differs from run to run."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # salt: splits rows that repeat in mass when places are given; any of them may take any of their places
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("int")
    return rows.withColumns({"virtual_slot": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"), "salt": salt})


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalanced(shard_of: list[int], load: list[int], shards: int) -> list[int]:
    """The next version of a map: moves or swaps slots between the heaviest and the lightest shard while that helps."""
    shard_of = list(shard_of)
    total = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        total[shard] += load[slot]
        own[shard].append((load[slot], slot))
    for x in own:
        x.sort()

    def put(item, source, to):
        own[source].remove(item)
        own[to].insert(bisect_left(own[to], item), item)
        shard_of[item[1]] = to
        total[source] -= item[0]
        total[to] += item[0]

    while True:  # each edit lowers the sum of the squares of the shards' bytes, so this ends
        heavy, light = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[heavy] - total[light]
        best = None
        for item in own[heavy]:  # a move, or a swap with the slot of the light shard that is nearest to ideal
            for back in [(0, -1), *own[light][max(0, (i := bisect_left(own[light], (item[0] - gap // 2, -1))) - 1) : i + 2]]:
                step = item[0] - back[0]
                if 0 < step < gap and (best is None or abs(2 * step - gap) < best[0]):
                    best = (abs(2 * step - gap), item, back)
        if best is None:
            break
        put(best[1], heavy, light)
        if best[2][1] >= 0:
            put(best[2], light, heavy)
    return shard_of


def grown(shard_of: list[int], load: list[int], shards: int) -> list[int]:
    """The next version for one more shard: slots move into it alone, the largest givers first, until it holds its share."""
    shard_of = list(shard_of)
    total = [0] * (shards + 1)
    for slot, shard in enumerate(shard_of):
        total[shard] += load[slot]
    share = sum(total) / (shards + 1)
    for slot in sorted(range(len(load)), key=lambda s: (-load[s], s)):
        if total[shards] + load[slot] <= share and total[shard_of[slot]] - load[slot] >= share - load[slot] and total[shard_of[slot]] > share:
            total[shard_of[slot]] -= load[slot]
            total[shards] += load[slot]
            shard_of[slot] = shards
    return shard_of


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """version, slot, shard: to be stored beside the shards; the largest version holds."""
    return spark.createDataFrame([(v, slot, shard) for v, x in enumerate(versions) for slot, shard in enumerate(x)], "version int, slot int, shard int")


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per slot: at most `slots` numbers come to the driver."""
    load = [0] * slots
    for slot, size in rows.groupBy("virtual_slot").agg(F.sum("size")).collect():
        load[slot] = size
    return load


def placed(rows: DataFrame, stored: DataFrame, n: int) -> DataFrame:
    """rows (a written table) with shard, by the last version of the stored map, and slot, the place from 0 in its shard."""
    last = stored.agg(F.max("version")).first()[0]
    now = stored.filter(F.col("version") == last).select(F.col("slot").alias("virtual_slot"), "shard")
    sub = F.pmod(F.xxhash64("text_crc32", "doc_id", "salt"), F.lit(max(1, buckets_for(rows, n) // 32)))
    dealt = rows.join(F.broadcast(now), "virtual_slot").withColumn("_sub", sub)  # one row per virtual slot
    return gapless(dealt, ["shard"], ["virtual_slot", "_sub"], ["doc_id", "text_crc32", "size"], "slot").drop("_sub", "salt")


def write_shards(docs: DataFrame, stored: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs with all columns, in a folder per shard, by the last version of the stored map."""
    last = stored.agg(F.max("version")).first()[0]
    now = stored.filter(F.col("version") == last).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    slot = F.pmod(F.xxhash64(id_col, crc), F.lit(SLOTS)).cast("int")
    names = fresh(docs.columns, "_slot", "_shard")
    dealt = docs.withColumn(names[0], slot).join(F.broadcast(now.toDF(*names)), names[0])
    dealt.repartition(names[1], names[0]).drop(names[0]).write.partitionBy(names[1]).parquet(path)


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(slotted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "slotted")
    load, first = slot_loads(rows), first_map()
    stored = written(map_table(spark, [first, rebalanced(first, load, SHARDS)]), "slot-map")
    return placed(rows, stored, rows.count()).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
