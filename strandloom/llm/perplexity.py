"""Quality classifier: an interpolated modified Kneser-Ney model over characters, trained on all trusted text.

Counts of n-grams are made beside the text, a row per distinct n-gram and batch, and summed by n-gram. Discounts,
contexts and lower orders follow from joins of these tables, which are sharded by n-gram: one row per n-gram with its
probability and, as a context, its back-off weight. N-grams that begin with the start sign keep their plain counts at lower
orders, since nothing else stands before them.

To score, documents form blocks of some MB where they are read. The commonest n-grams, HOT_GRAMS of each length at most, are
known to every worker and are summed there. Of the rest a block asks for the distinct ones, the join with the model answers, and answers
meet the block's list of (document, n-gram, times) in one task: texts never move, no n-gram is asked for by
nearly every block, and the model is not broadcast, however much trusted text there is. Which n-grams are common changes what
moves, never a result.

A document's perplexity is per character. Its distance from its language's median counts times the root of the number
of characters, since short texts vary more; what lies above the language's upper quartile by a multiple of the quartiles'
distance is rejected. A low perplexity is no reason to reject: copies have it too.

Median and quartiles come from all trusted texts of the language, each text once, so no amount of junk moves them. For
this, a trusted text is scored as if it had been left out: an n-gram that only it has counts as one never seen. All other
texts of a language weigh as much as PULL trusted ones together: they set the limit where there is no trusted text, and the more
there is, the less they matter. Quantiles are exact for values rounded to four (three) decimals.

Defined results. Null or empty text, and text without a letter or digit: perplexity null, not kept. Null language: a
language of its own. No trusted text: perplexity null, every other text is kept. Repeated rows: rows of their own. Null
doc_id: scored, never trusted. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Located, join_checked, map_arrow, written

ORDER = 5
#: The signs that stand before a text and behind it.
BEGIN, OVER = "\x02", "\x03"
BLOCK_CHARS, CHUNK = 32 << 20, 1 << 20
#: Cells of a table that numbers n-grams directly; where there are more, they are sorted.
CELLS = 1 << 23
REACH, NARROWEST = 6.0, 0.5
#: Most n-grams of each length that every worker knows; trusted texts that a language's other texts weigh as much as.
HOT_GRAMS, PULL = 1 << 18, 50
#: Bytes of a table that training may broadcast.
TRAIN_BROADCAST = 32 << 20
_CLEAR = str.maketrans({BEGIN: " ", OVER: " "})
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def padded(text: str, order: int = ORDER) -> str:
    return BEGIN * (order - 1) + text.translate(_CLEAR) + OVER


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def keys(grams: np.ndarray) -> np.ndarray:
    """A 64-bit key of every row of code points."""
    out = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        out += (grams[:, j] + np.uint64(1)) * _FACTORS[j]
    out ^= out >> np.uint64(29)
    return out * _FACTORS[0]


def compact(key: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the values of key, all below size, and how many there are."""
    if size > CELLS:
        which, number = np.unique(key, return_inverse=True)
        return number.astype(np.int32), len(which)
    table = np.zeros(size, np.int32)
    table[key] = 1
    which = np.flatnonzero(table)
    table[which] = np.arange(len(which), dtype=np.int32)
    return table[key], len(which)


def numbered(codes: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """A number of the n-gram at each place, made sign by sign: a longer n-gram's key is its beginning's number and its last sign."""
    signs, n_signs = compact(codes.astype(np.int64), 0x110000)
    now, n = signs, n_signs
    for k in range(1, order):
        now, n = compact(now[:-1].astype(np.int64) * n_signs + signs[k:], n * n_signs)
    return now, n


def starts(texts: list[str], order: int) -> np.ndarray:
    """Whether an n-gram of the joined texts begins at each place and stays inside one text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.ones(int(sizes.sum()), bool)
    ends = np.cumsum(sizes)
    for j in range(1, order):
        inside[ends - j] = False
    return inside


def chunks(texts: list[str], most: int):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, the number of each n-gram inside a text in order, and a place and the count of each number met."""
    joined = "".join(texts)
    at = np.flatnonzero(starts(texts, order)[: max(0, len(joined) - order + 1)])
    every, n = numbered(points(joined), order)
    number = every[at]
    place = np.full(n, -1, np.int64)
    place[number] = at
    return joined, number, place, np.bincount(number, minlength=n)


def gram_counts(texts: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of padded texts, and how often each stands there."""
    joined, _, place, counts = distinct(texts, order)
    met = place >= 0
    return [joined[i : i + order] for i in place[met].tolist()], counts[met]


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Of counts one, two, and three or more, from how many n-grams have each of the counts up to four."""
    n = {r["c"]: r["count"] for r in counts.filter("c <= 4").groupBy("c").count().collect()}  # four rows
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def train(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """The model table (gram, p, back, n: plain count) and the probability of a sign never seen, from a table with the column text.

    The longest n-grams are no contexts: back is their count.
    """

    def kernel(batches):
        for batch in batches:
            for part in chunks((padded(t, order) for t in batch.column(0).to_pylist() if t), CHUNK):
                grams, n = gram_counts(part, order)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["gram", "c"])

    top = map_arrow(texts, kernel, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    levels = {order: written(top.withColumn("plain", F.col("c")), "grams")}
    for k in range(order - 1, 0, -1):  # how many signs stand before it
        lower = levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("before"), F.sum("plain").alias("plain"))
        levels[k] = written(lower.select("gram", F.when(F.col("gram").startswith(BEGIN), F.col("plain")).otherwise(F.col("before")).alias("c"), "plain"), "grams")
    vocabulary = levels[1].count() + 1
    below: DataFrame | None = None
    parts = []
    unseen = 1.0 / vocabulary
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(levels[k])
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = levels[k].withColumns({"d": taken, "context": F.substring("gram", 1, k - 1)})
        contexts = written(rows.groupBy("context").agg(F.sum("c").alias("all"), F.sum(F.col("d").cast("decimal(20,12)")).cast("double").alias("free")), "contexts")
        if k == 1:
            total, free = contexts.select("all", "free").first() or (1, 1.0)
            unseen = free / total / vocabulary
            level = rows.select("gram", "c", "plain", ((F.col("c") - F.col("d")) / F.lit(total) + F.lit(unseen)).alias("p"))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            both = join_checked(rows.withColumn("suffix", F.substring("gram", 2, k - 1)), contexts, "context", "inner", TRAIN_BROADCAST)
            both = join_checked(both, lower, "suffix", "inner", TRAIN_BROADCAST)
            level = both.select("gram", "c", "plain", ((F.col("c") - F.col("d") + F.col("free") * F.col("q")) / F.col("all")).alias("p"))
            parts.append(contexts.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("free") / F.col("all")).alias("back"), F.lit(None).cast("long").alias("n")))
        below = written(level, "level")
        parts.append(below.select("gram", "p", (F.col("c") if k == order else F.lit(None)).cast("double").alias("back"), F.col("plain").alias("n")))
    table = parts[0]
    for x in parts[1:]:
        table = table.unionByName(x)
    model = table.groupBy("gram").agg(F.max("p").alias("p"), F.max("back").alias("back"), F.max("n").alias("n"))
    return written(model, "model"), unseen


class Lookup:
    """Some entries of a model, by key and length; what it lacks is taken from another."""

    def __init__(self, grams: list[str], p: np.ndarray, back: np.ndarray, unseen: float, order: int = ORDER, other: Lookup | None = None):
        self.order, self.unseen, self.other, self.tables = order, unseen, other, {}
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        for k in range(1, order + 1):
            mine = np.flatnonzero(sizes == k)
            found = keys(points("".join([grams[i] for i in mine.tolist()])).reshape(-1, k))
            by = np.argsort(found)
            self.tables[k] = found[by], p[mine][by], back[mine][by]

    def has(self, k: int, wanted: np.ndarray) -> np.ndarray:
        found = self.tables[k][0]
        return found[np.minimum(np.searchsorted(found, wanted), len(found) - 1)] == wanted if len(found) else np.zeros(len(wanted), bool)

    def get(self, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability and weight (or count) of n-grams of k signs, nan for what the model lacks."""
        p, back = self.other.get(k, wanted) if self.other else (np.full(len(wanted), np.nan) for _ in range(2))
        found, own_p, own_back = self.tables[k]
        if len(found):
            at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
            hit = found[at] == wanted
            p, back = np.where(hit, own_p[at], p), np.where(hit, own_back[at], back)
        return p, back

    def resolve(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams (rows of code points): probability, that without the n-gram itself, and the model's count of it or nan."""
        order = self.order
        prob = without = np.full(len(grams), self.unseen)
        count = np.full(len(grams), np.nan)
        for k in range(1, order + 1):
            p, count = self.get(k, keys(grams[:, order - k :]))
            if k > 1:
                _, weight = self.get(k - 1, keys(grams[:, order - k : order - 1]))
                prob = np.where(np.isnan(weight), 1.0, weight) * prob
            without = prob
            prob = np.where(np.isnan(p), prob, p)
        return prob, without, count


def hot_grams(model: DataFrame, unseen: float, order: int = ORDER, most: int = HOT_GRAMS) -> tuple[tuple, set[int]]:
    """What a Lookup of the commonest n-grams is made of, and the lengths of which it has all.

    Of each length, all whose count is in the highest classes that together have no more than `most`; of the longest ones
    also beginnings and ends. So many rows come to the driver.
    """
    n = F.coalesce("n", F.lit(1 << 40))  # start signs alone have no count
    size, length = F.floor(16 * F.log2(n)), F.length("gram")  # sixteen classes for each doubling of the count
    classes = sorted(model.groupBy(length.alias("k"), size.alias("size")).count().collect(), key=lambda r: (r["k"], -r["size"]))
    wanted, whole = F.lit(False), set()
    for k in range(1, order + 1):
        left, least, every = most, None, True
        for r in (r for r in classes if r["k"] == k):
            if r["count"] > left:
                every = False
                break
            left, least = left - r["count"], r["size"]
        if every:
            whole.add(k)
        if least is not None:
            wanted = wanted | ((length == k) & (size >= least))
    hot = model.filter(wanted)
    names = hot.select("gram").union(hot.filter(length == order).select(F.explode(F.array(F.substring("gram", 1, order - 1), F.substring("gram", 2, order - 1))))).distinct()
    found = model.join(names, "gram").select("gram", "p", "back").toArrow()  # `most` times (order + 2) at most
    return (found["gram"].to_pylist(), found["p"].to_numpy(), found["back"].to_numpy(), unseen, order), whole


def perplexities(docs: DataFrame, model: DataFrame, unseen: float, order: int = ORDER, most: int | None = None) -> DataFrame:
    """doc_id, lang, at_file, at_place, text_key, n_signs, perplexity, left_out of every row of docs (doc_id, text, lang, at_file, at_place).

    left_out: the perplexity of a text of the training as if it had been left out.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_grams(model, unseen, order, HOT_GRAMS if most is None else most))
    meta = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at_file", pa.int64()), ("at_place", pa.int64()), ("text_key", pa.string()), ("n_signs", pa.int64()), ("ok", pa.bool_()), ("sum", pa.float64()), ("left", pa.float64())])
    cold = pa.schema([("row", pa.int32()), ("gram", pa.int32()), ("times", pa.int32())])

    def logs(prob, without, count, row, gram, times, n):
        """Sums by row of times log p of grams; and the same with p as without the gram where no other text has it."""
        own = np.log(np.where(times == count[gram], without[gram], prob[gram]))
        return (np.bincount(row, times * x, n) for x in (np.log(prob)[gram], own))

    def ask(batches):
        import hashlib

        import xxhash

        parts, whole = hot.value
        known = Lookup(*parts)
        all_known = len(whole) == order

        def close(rows):
            texts = [r[1] or "" for r in rows]
            sums, left = np.zeros(len(rows)), np.zeros(len(rows))
            number: dict[str, int] = {}
            asked: list[tuple] = []
            first = 0
            for part in chunks((padded(t, order) for t in texts), CHUNK):
                joined, at, place, here = distinct(part, order)
                row = np.repeat(np.arange(first, first + len(part)), [len(t) - order + 1 for t in part])
                grams = points(joined)[np.maximum(place, 0)[:, None] + np.arange(order)]
                there = known.has(order, keys(grams)) | all_known
                prob, without, count = (np.zeros(len(grams)) for _ in range(3))
                prob[there], without[there], count[there] = known.resolve(grams[there])
                log_p = np.log(np.where(there, prob, 1.0))[at]
                begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                sums[first : first + len(part)] += np.add.reduceat(log_p, begins)
                # few n-grams are left: those that may stand in one text only, and those that are not known here
                few = np.flatnonzero((~there | (count <= here))[at])
                pair, times = np.unique(row[few] * np.int64(len(grams)) + at[few], return_counts=True)
                row, gram = pair // len(grams), pair % len(grams)
                alone = there[gram] & (times == count[gram])
                more = times * (np.log(np.where(alone, without[gram], 1.0)) - np.log(np.where(alone, prob[gram], 1.0)))
                left += np.bincount(row, more, len(rows))
                rest = ~there[gram]
                which, index = np.unique(gram[rest], return_inverse=True)
                names = np.fromiter((number.setdefault(joined[i : i + order], len(number)) for i in place[which].tolist()), np.int64, len(which))
                asked.append((row[rest], names[index], times[rest]))
                first += len(part)
            left += sums
            columns = [[r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], [len(t) + 1 for t in texts], [any(map(str.isalnum, t)) for t in texts], sums, left]
            counts = pa.table([pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*asked)], schema=cold) if asked else cold.empty_table()
            wanted = set()
            for j in (order - 1, order):
                for i in range(j):
                    some = list({g[i:j] for g in number})
                    if j - i in whole:
                        continue
                    if some and (j, i) != (order, 0):
                        new = ~known.has(j - i, keys(points("".join(some)).reshape(-1, j - i)))
                        some = [some[x] for x in np.flatnonzero(new).tolist()]
                    wanted.update(some)
            block = xxhash.xxh64_intdigest(f"{rows[0][3]},{rows[0][4]}".encode()) - (1 << 63)
            data = pa.table([pa.array(x, f.type) for x, f in zip(columns, meta)], schema=meta), counts, list(number)
            return block, list(wanted), packed(*data)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                size += len(row[1] or "")
                if size >= BLOCK_CHARS:
                    yield asks(*close(held))
                    held, size = [], 0
        if held:
            yield asks(*close(held))

    def asks(block, grams, data):
        n = len(grams)
        return pa.RecordBatch.from_arrays([pa.array([block] * (n + 1), pa.int64()), pa.array([*grams, None], pa.string()), pa.array([None] * n + [data], pa.binary())], ["block", "gram", "data"])

    def score(key, texts, answers):
        lookup = Lookup(answers["gram"].to_pylist(), *(answers[c].to_numpy() for c in ("p", "back")), unseen, order, Lookup(*hot.value[0]))
        out = []
        for data in texts["data"].to_pylist():
            table, counts, grams = unpacked(data)
            sums, left = table["sum"].to_numpy(), table["left"].to_numpy()
            if grams:
                found = lookup.resolve(points("".join(grams)).reshape(-1, order))
                more = logs(*found, *(counts[c].to_numpy() for c in ("row", "gram", "times")), len(sums))
                sums, left = (x + y for x, y in zip((sums, left), more))
            fine = table["ok"].to_numpy(zero_copy_only=False)
            # rounded, so that the order of the sums does not show
            ppl = [pa.array(np.exp(-np.round(x, 6) / table["n_signs"].to_numpy()), mask=~fine) for x in (sums, left)]
            out.append(table.drop_columns(["ok", "sum", "left"]).append_column("perplexity", ppl[0]).append_column("left_out", ppl[1]))
        return pa.concat_tables(out)

    schema = "doc_id long, lang string, at_file long, at_place long, text_key string, n_signs long, perplexity double, left_out double"
    emitted = written(map_arrow(docs.select("doc_id", "text", "lang", "at_file", "at_place"), ask, "block long, gram string, data binary"), "blocks")
    answers = emitted.filter("gram IS NOT NULL").select(F.col("block").alias("of"), "gram").join(model, "gram").groupBy("of")
    return emitted.filter("data IS NOT NULL").select("block", "data").groupBy("block").cogroup(answers).applyInArrow(score, schema)


def packed(table: pa.Table, counts: pa.Table, grams: list[str]) -> bytes:
    """Three tables as one compressed value."""
    out = []
    for x in (table, counts, pa.table({"gram": pa.array(grams, pa.string())})):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(x)
        data = sink.getvalue().to_pybytes()
        out += [len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpacked(data: bytes) -> tuple[pa.Table, pa.Table, list[str]]:
    out, at = [], 0
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at : at + 8], "little")
        out.append(pa.ipc.open_stream(data[at + 8 : end]).read_all())
        at = end
    return out[0], out[1], out[2]["gram"].to_pylist()


def band_of(lang):
    """A name for each language, null being one."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def judged(scores: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """scores (a written table) with distance and kept: the distance from the language's median is not above the language's limit."""
    named = trusted_ids.select("doc_id", F.lit(True).alias("trusted"))
    known = join_checked(scores.filter("perplexity IS NOT NULL"), named, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    # copies are folded where they are read, so a text with many of them is no large group
    once = known.groupBy(band_of(F.col("lang")).alias("band"), "text_key", "n_signs").agg(F.max("trusted").alias("trusted"), F.min("perplexity").alias("perplexity"), F.min("left_out").alias("left_out"))
    log_p = F.log(F.when(F.col("trusted"), F.col("left_out")).otherwise(F.col("perplexity")))
    once = written(once.select("band", "n_signs", "trusted", F.round(log_p, 4).alias("log_p")), "texts")
    others = written(once.groupBy("band").agg(F.count_if(~F.col("trusted")).alias("n_others")), "bands")

    def weighed(value):
        """band, value, weight: a million for each trusted text, and PULL millions for all others of a band together."""
        bins = value.groupBy("band", "value").agg(F.count_if("trusted").alias("own"), F.count_if(~F.col("trusted")).alias("other"))
        share = F.ceil(F.lit(PULL * 1_000_000) * F.col("other") / F.greatest("n_others", F.lit(1)))
        return bins.join(others, "band").select("band", "value", (F.col("own") * 1_000_000 + share).cast("long").alias("weight"))

    middles = written(weighed(once.withColumn("value", F.col("log_p"))).groupBy("band").agg(F.percentile("value", 0.5, F.col("weight")).alias("middle")), "medians")
    away = once.join(middles, "band").withColumn("value", F.round((F.col("log_p") - F.col("middle")) * F.sqrt("n_signs"), 3))
    quarter = F.percentile("value", [0.25, 0.75], F.col("weight"))
    spread = F.greatest(quarter[1] - quarter[0], F.lit(NARROWEST)) * REACH
    ends = written(weighed(away).groupBy("band").agg((quarter[1] + spread).alias("high")).join(middles, "band").withColumnRenamed("band", "_band"), "limits")
    far = scores.join(ends, band_of(F.col("lang")) == F.col("_band"), "left")
    far = far.withColumn("distance", (F.log("perplexity") - F.col("middle")) * F.sqrt("n_signs"))
    return far.select("doc_id", "lang", "at_file", "at_place", "text_key", "n_signs", "perplexity", "distance", F.coalesce(F.col("distance") <= F.col("high"), F.lit(False)).alias("kept"))


def verdicts(texts: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, at_file, at_place, text_key, n_signs, perplexity, distance, kept of every row of texts (doc_id, text, lang, at_file, at_place)."""
    ids = written(trusted_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "trusted")
    trusted = join_checked(texts.select("doc_id", "text"), ids, "doc_id", "left_semi").select("text")
    if not trusted.limit(1).count():
        text = F.coalesce("text", F.lit(""))
        none = F.lit(None).cast("double")
        return texts.select(
            "doc_id", "lang", "at_file", "at_place", F.md5(text.cast("binary")).alias("text_key"), (F.length(text) + 1).cast("long").alias("n_signs"),
            none.alias("perplexity"), none.alias("distance"), text.rlike(r"[\p{L}\p{N}]").alias("kept"),
        )
    model, unseen = train(trusted)
    return judged(written(perplexities(texts, model, unseen), "perplexities"), ids)


def located(at: Located, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return at.select(doc_id=F.col(id_col).cast("long"), text=F.col(text_col), lang=F.col(lang_col).cast("string"))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, text_key, n_signs, perplexity, distance, kept of every row; trusted_ids has the column doc_id."""
    return verdicts(located(Located(docs), id_col, text_col, lang_col), trusted_ids).drop("at_file", "at_place")


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of good quality, none of which is toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rejected rows, columns as they were."""
    at = Located(docs)
    return at.keep(verdicts(located(at, id_col, text_col, lang_col), trusted_ids))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, trusted_labels(spark, sf_dir)).drop("text_key")
