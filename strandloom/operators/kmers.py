"""K-mers, minimizers and rolling hashes of sequences: one Arrow kernel per plan, vectorised over a batch.

A batch's sequences are joined to one array of codes. Values of all windows come from doubling shorter ones, so a k-mer
costs about 2 log2(k) vector operations, and windows that hold an ambiguous letter or cross a sequence are masked out.
`counted` folds equal k-mers of a batch before they leave the worker, which is what most plans need.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.specs import Seed, alphabet
from ..storage import join_checked, written

#: Letters that a kernel works on at once.
CHUNK = 1 << 21


def windows(codes: np.ndarray, base: int, k: int) -> np.ndarray:
    """Value of every window of k codes, first code most significant."""
    return hashes._double(codes.astype(np.int64), k, lambda head, tail, n: head * (base**n) + tail)


def other_strand(codes: np.ndarray, k: int) -> np.ndarray:
    """Value of the reverse complement of every window of k bases."""
    return hashes._double(3 - codes.astype(np.int64), k, lambda head, tail, n, m: tail * (4**m) + head, back=True)


def clean_windows(codes: np.ndarray, owner: np.ndarray, span: int, offsets: Sequence[int] | None = None) -> np.ndarray:
    """Whether the window at each place lies in one sequence and has no ambiguous letter where it is read."""
    n = len(codes) - span + 1
    if n <= 0:
        return np.zeros(0, bool)
    bad = codes < 0
    same = owner[:n] == owner[span - 1 : span - 1 + n]
    if offsets is not None:
        for o in offsets:
            same &= ~bad[o : o + n]
        return same
    before = np.concatenate([[0], np.cumsum(bad)])
    return same & (before[span:] - before[:n] == 0)


def shannon(kmers: np.ndarray, k: int) -> np.ndarray:
    """Entropy in bits of the bases of each k-mer, to nine decimals."""
    counts = np.zeros((4, len(kmers)), np.int64)
    x = kmers.copy()
    for _ in range(k):
        last = x & 3
        for b in range(4):
            counts[b] += last == b
        x >>= 2
    p = counts / k
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(-np.where(p > 0, p * np.log2(p), 0.0).sum(axis=0), 9)


def least_of(rank: np.ndarray, m: int) -> np.ndarray:
    """Index of the least rank in every run of m, the first of equals, in log2(m) steps."""
    best = np.arange(len(rank))
    size = 1
    while size < m:
        step = min(size, m - size)
        n = len(best) - step
        left, right = best[:n], best[step : step + n]
        best = np.where(rank[right] < rank[left], right, left)
        size += step
    return best


#: A name of SCORES, or a function of k-mers (values, k) that gives each one's score, least first. It runs in the workers.
Score = str | Callable[[np.ndarray, int], np.ndarray]
SCORES: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "raw": lambda kmers, k: kmers,
    "lexical": lambda kmers, k: hashes.lexical_score(kmers),
    "entropy": lambda kmers, k: -shannon(kmers, k),
}


def seeds_of(codes: np.ndarray, owner: np.ndarray, seed: Seed) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of all clean seeds."""
    base = alphabet(seed.alphabet).base
    safe = np.maximum(codes, 0)
    if seed.spaced:
        offsets = seed.offsets()
        clean = clean_windows(codes, owner, seed.span, offsets)
        n = len(clean)
        value = np.zeros(n, np.int64)
        for o in offsets:
            value = value * base + safe[o : o + n]
    else:
        clean = clean_windows(codes, owner, seed.k)
        if not len(clean):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = windows(safe, base, seed.k)
        if not seed.stranded:
            value = np.minimum(value, other_strand(safe, seed.k))
    at = np.flatnonzero(clean)
    return at, value[at]


def minimizers_of(at: np.ndarray, value: np.ndarray, owner: np.ndarray, seed: Seed, score: Score, across_gaps: bool, partial: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the least (score, value) of every full window; one per window, so repeats stay.

    partial: a sequence whose seeds are fewer than a window has also gives its least one.
    """
    if seed.window == 1 or not len(at):
        return at, value
    points = SCORES[score](value, seed.k) if isinstance(score, str) else score(value, seed.k)
    return least_of_windows(at, value, points, owner, seed.window, across_gaps, partial)


def least_of_windows(at: np.ndarray, value: np.ndarray, points: np.ndarray, owner: np.ndarray, m: int, across_gaps: bool, partial: bool) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, points))
    rank = np.empty(len(order), np.int64)
    new = np.concatenate([[False], (points[order][1:] != points[order][:-1]) | (value[order][1:] != value[order][:-1])])
    rank[order] = np.cumsum(new)
    best = least_of(rank, m) if len(at) >= m else np.zeros(0, np.int64)
    first, last = at[: len(best)], at[m - 1 :]
    # by default a window has neighbouring seeds only; across gaps it counts seeds, whatever lies between
    whole = owner[first] == owner[last] if across_gaps else last - first == m - 1
    best = best[whole]
    if partial:
        begin = np.flatnonzero(np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]]))
        size = np.diff(np.append(begin, len(at)))
        least = np.minimum.reduceat(rank * len(at) + np.arange(len(at)), begin) % len(at)  # the first of equals
        best = np.sort(np.concatenate([best, least[size < m]]))
    return at[best], value[best]


def joined(texts: Sequence[str | None], lut: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first index, codes, owner of each letter, begin of each text) of chunks of texts."""
    at = 0
    while at < len(texts):
        held, size, i = [], 0, at
        while i < len(texts) and (not held or size < CHUNK):
            data = (texts[i] or "").encode("latin-1", "replace")
            held.append(data)
            size += len(data)
            i += 1
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        raw = np.frombuffer(b"".join(held), np.uint8)
        yield at, lut[raw], np.repeat(np.arange(len(held)), sizes), np.cumsum(sizes) - sizes
        at = i


def _keyed(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return df.select(*keys, F.col(seq).alias("_seq"))


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def kmers(df: DataFrame, seed: Seed, keys: Sequence[str] = ("id",), seq: str = "seq", score: Score = "raw", across_gaps: bool = False, partial: bool = False) -> DataFrame:
    """keys, pos (from 0), kmer: a row per k-mer, or per window if the seed has windows."""
    keys = list(keys)

    def kernel(batches):
        lut = alphabet(seed.alphabet).lut()
        for batch in batches:
            for first, codes, owner, begin in joined(batch.column(len(keys)).to_pylist(), lut):
                at, value = seeds_of(codes, owner, seed)
                at, value = minimizers_of(at, value, owner, seed, score, across_gaps, partial)
                row = pa.array(owner[at] + first)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], pa.array(at - begin[owner[at]]), pa.array(value)], [*keys, "pos", "kmer"])

    return _keyed(df, keys, seq).mapInArrow(kernel, _types(df, keys) + "pos long, kmer long")


def parts(df: DataFrame, seed: Seed, keys: Sequence[str] = (), seq: str = "seq", score: Score = "raw", across_gaps: bool = False, partial: bool = False) -> DataFrame:
    """keys, kmer, n: folded within each batch only, so a key's k-mer may have several rows. No shuffle."""
    keys = list(keys)

    def kernel(batches):
        lut = alphabet(seed.alphabet).lut()
        for batch in batches:
            groups, members = grouped([batch.column(i) for i in range(len(keys))], batch.num_rows)
            for first, codes, owner, _ in joined(batch.column(len(keys)).to_pylist(), lut):
                at, value = seeds_of(codes, owner, seed)
                at, value = minimizers_of(at, value, owner, seed, score, across_gaps, partial)
                group, value, n = folded(groups[owner[at] + first], value)
                row = pa.array(members[group])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], pa.array(value), pa.array(n)], [*keys, "kmer", "n"])

    return _keyed(df, keys, seq).mapInArrow(kernel, _types(df, keys) + "kmer long, n long")


def counted(df: DataFrame, seed: Seed, keys: Sequence[str] = (), seq: str = "seq", score: Score = "raw", across_gaps: bool = False, partial: bool = False) -> DataFrame:
    """keys, kmer, n: how often each k-mer stands in the sequences of each key. Counts leave a worker already folded."""
    return parts(df, seed, keys, seq, score, across_gaps, partial).groupBy(*keys, "kmer").agg(F.sum("n").alias("n"))


def counted_each(df: DataFrame, seed: Seed, key: str = "id", seq: str = "seq", score: Score = "raw", across_gaps: bool = False, partial: bool = False) -> DataFrame:
    """key, kmer, n like counted(); where key tells all rows apart, each row's counts are whole as they leave the kernel.

    The keys are counted first, which moves keys alone; k-mers are then shuffled only if some key repeats or is null.
    """
    n, kinds = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    return (parts if n == kinds else counted)(df, seed, [key], seq, score, across_gaps, partial)


def spans(df: DataFrame, seed: Seed, number: str, seq: str = "seq", score: Score = "raw") -> DataFrame:
    """kmer, lo, hi, n: the least and the greatest `number` (no less than zero) of the rows that hold each k-mer, and how many do.

    Batches leave the kernel as one row per k-mer, so what is shuffled does not grow with the number of numbers.
    """

    def kernel(batches):
        lut = alphabet(seed.alphabet).lut()
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, codes, owner, _ in joined(batch.column(1).to_pylist(), lut):
                at, value = seeds_of(codes, owner, seed)
                at, value = minimizers_of(at, value, owner, seed, score, False)
                value, row, _ = folded(value, owner[at])  # by k-mer, then by row
                begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])[: len(value)])
                if len(begin):
                    of = numbers[row + first]
                    columns = value[begin], np.minimum.reduceat(of, begin), np.maximum.reduceat(of, begin), np.diff(np.append(begin, len(value)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kmer", "lo", "hi", "n"])

    part = df.select(F.col(number).cast("long"), F.col(seq)).filter(F.col(number).isNotNull()).mapInArrow(kernel, "kmer long, lo long, hi long, n long")
    return part.groupBy("kmer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def for_each(df: DataFrame, seed: Seed, f: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, keys: Sequence[str] = ("id",), seq: str = "seq", score: Score = "raw") -> DataFrame:
    """keys and what f makes of k-mers: f(row, pos, kmer) returns columns as named in schema, and row, the number of the row each belongs to."""
    keys = list(keys)
    names = [x.split()[0] for x in schema.split(",")]

    def kernel(batches):
        lut = alphabet(seed.alphabet).lut()
        for batch in batches:
            for first, codes, owner, begin in joined(batch.column(len(keys)).to_pylist(), lut):
                at, value = minimizers_of(*seeds_of(codes, owner, seed), owner, seed, score, False)
                got = f(owner[at] + first, at - begin[owner[at]], value)
                row = pa.array(got["row"])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], *[pa.array(got[n]) for n in names]], [*keys, *names])

    return _keyed(df, keys, seq).mapInArrow(kernel, _types(df, keys) + schema)


def jaccards(pairs: DataFrame, df: DataFrame, seed: Seed, key: str = "id", seq: str = "seq") -> DataFrame:
    """i, j, jaccard of the k-mer sets of pairs (i, j) of keys, for those that share one; each pair once.

    What moves are sequences, deflated to about a quarter of a byte a letter, and k-mers never: a pair's shorter one meets
    the longer, whose set a task holds while its pairs go by. Rows of equal keys are one set.
    """
    kind = dict(df.dtypes)[key]

    def pack(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            data = [zlib.compress((x or "").encode("latin-1", "replace"), 1) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or "") for x in texts], pa.int64()), pa.array(data, pa.binary())], ["id", "size", "data"])

    def kernel(batches):
        lut = alphabet(seed.alphabet).lut()
        held, mine = None, None
        for batch in batches:
            out = []
            of, with_, data = (c.to_pylist() for c in batch.columns)
            for a, b, packed in zip(of, with_, data):
                codes = lut[np.frombuffer(b"".join(b"." + zlib.decompress(x) for x in packed), np.uint8)]
                _, value = seeds_of(codes, np.zeros(len(codes), np.int8), seed)
                value = np.unique(value)
                if b is None:  # the longer one comes before its pairs
                    held, mine = a, value
                    continue
                assert a == held
                both = np.sort(np.concatenate([mine, value]))
                if n := int(np.count_nonzero(both[1:] == both[:-1])):
                    out.append((a, b, n / (len(both) - n)))
            if out:
                i, j, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(i, batch.schema.field(0).type), pa.array(j, batch.schema.field(0).type), pa.array(v)], ["i", "j", "jaccard"])

    asked = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    texts = df.select(F.col(key).alias("id"), F.col(seq).alias("_seq")).mapInArrow(pack, f"id {kind}, size long, data binary")
    texts = written(texts.join(asked, "id", "left_semi").groupBy("id").agg(F.sum("size").alias("size"), F.collect_list("data").alias("data")), "texts")
    sizes = texts.select("id", "size")
    a, b = sizes.select(F.col("id").alias("i"), F.col("size").alias("si")), sizes.select(F.col("id").alias("j"), F.col("size").alias("sj"))
    first = F.col("si") >= F.col("sj")
    sided = pairs.select("i", "j").join(a, "i").join(b, "j").select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("of"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("id"))
    sided = written(sided, "sided")
    longer = sided.select(F.col("of").alias("id")).distinct().join(texts, "id").select(F.col("id").alias("of"), F.lit(None).cast(kind).alias("id"), "data")
    rows = longer.unionByName(sided.join(texts, "id").select("of", "id", "data"))
    return rows.repartition("of").sortWithinPartitions("of", F.col("id").asc_nulls_first()).mapInArrow(kernel, f"i {kind}, j {kind}, jaccard double")


def window_entropy(df: DataFrame, k: int, keys: Sequence[str] = ("id",), seq: str = "seq", alphabet_name: str = "DNA4") -> DataFrame:
    """keys, pos, value: at each letter the sum of p ln p over the last k letters since the last ambiguous one; -1 for fewer than k."""
    keys = list(keys)

    def kernel(batches):
        one = alphabet(alphabet_name)
        for batch in batches:
            for first, codes, owner, begin in joined(batch.column(len(keys)).to_pylist(), one.lut()):
                clean = clean_windows(codes, owner, k)
                value = np.full(len(codes), -1.0)
                if len(clean):
                    total = np.zeros(len(clean))
                    for c in range(one.base):
                        sums = np.concatenate([[0], np.cumsum(codes == c)])
                        p = (sums[k:] - sums[:-k]) / k
                        total += np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0)
                    value[k - 1 :] = np.where(clean, total, -1.0)
                at = np.flatnonzero(codes >= 0)
                row = pa.array(owner[at] + first)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], pa.array(at - begin[owner[at]]), pa.array(value[at])], [*keys, "pos", "value"])

    return _keyed(df, keys, seq).mapInArrow(kernel, _types(df, keys) + "pos long, value double")


def grouped(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A group number for each row, and a row of each group."""
    if not columns:
        return np.zeros(n, np.int64), np.zeros(1, np.int64)
    if len(columns) == 1:
        number = columns[0].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    else:
        seen: dict[tuple, int] = {}
        number = np.fromiter((seen.setdefault(x, len(seen)) for x in zip(*[c.to_pylist() for c in columns])), np.int64, n)
    _, members, groups = np.unique(number, return_index=True, return_inverse=True)
    return groups, members


def folded(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) and how often each stands there; both are no less than zero, or value is a plain word."""
    if not len(value):
        return group, value, np.zeros(0, np.int64)
    top, groups = int(value.max()) + 1, int(group.max()) + 1
    if value.min() >= 0 and top * groups < 1 << 63:  # one number for both, which sorts fast
        key = group * top + value
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group, value = np.divmod(key[at], top)
        return group, value, np.diff(np.append(at, len(key)))
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]))
    return group[at], value[at], np.diff(np.append(at, len(group)))


def multi_k(df: DataFrame, ks: Sequence[int], keys: Sequence[str] = (), seq: str = "seq", canonical: bool = True, saturate: int | None = None) -> DataFrame:
    """keys, k, kmer, n for several k, in one pass over the sequences; counts stop at `saturate`."""
    keys, ks = list(keys), list(ks)

    def kernel(batches):
        lut = alphabet("DNA4").lut()
        for batch in batches:
            groups, members = grouped([batch.column(i) for i in range(len(keys))], batch.num_rows)
            for first, codes, owner, _ in joined(batch.column(len(keys)).to_pylist(), lut):
                for k in ks:
                    at, value = seeds_of(codes, owner, Seed(k, canonical=canonical))
                    group, value, n = folded(groups[owner[at] + first], value)
                    row = pa.array(members[group])
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], pa.array(np.full(len(n), k, np.int32)), pa.array(value), pa.array(n)], [*keys, "k", "kmer", "n"])

    part = _keyed(df, keys, seq).mapInArrow(kernel, _types(df, keys) + "k int, kmer long, n long")
    total = F.sum("n")
    return part.groupBy(*keys, "k", "kmer").agg((F.least(total, F.lit(saturate)) if saturate else total).alias("n"))


ROLLING = ("cyclic", "karp_rabin", "strand_free")


def _check_family(family: str, alphabet_name: str) -> None:
    if family not in ROLLING or family == "strand_free" and alphabet_name not in ("DNA4", "DNA"):
        raise ValueError("hash families: cyclic and karp_rabin for any alphabet, strand_free for DNA")


def _hash_of(codes: np.ndarray, k: int, family: str, words: np.ndarray) -> np.ndarray:
    """The hash of every window of k codes, clean or not."""
    if family == "karp_rabin":
        return hashes.karp_rabin(codes, k)
    return hashes.cyclic(codes, k, words) if family == "cyclic" else hashes.strand_free(codes, k, words, np.array([3, 2, 1, 0]))


def rolling_set(df: DataFrame, ks: Sequence[int], w: int = 0, keys: Sequence[str] = ("id",), seq: str = "seq", family: str = "strand_free", alphabet_name: str = "DNA4", seed: int = 137, partial: bool = False) -> DataFrame:
    """keys, k, pos, hash: a rolling hash of every window of k letters, for several k of any length in one pass over the sequences.

    With w over k, the least of every full window of w letters; partial: of a shorter sequence also the least of all. Hashes
    are unsigned words kept in signed longs; the least is the least unsigned one.
    """
    _check_family(family, alphabet_name)
    keys, ks = list(keys), list(ks)

    def kernel(batches):
        one = alphabet(alphabet_name)
        lut, words = one.lut(), hashes.table(seed, max(one.base, 4))
        for batch in batches:
            for first, codes, owner, begin in joined(batch.column(len(keys)).to_pylist(), lut):
                safe = np.maximum(codes, 0)
                for k in ks:
                    at = np.flatnonzero(clean_windows(codes, owner, k))
                    if not len(at):
                        continue
                    value = _hash_of(safe, k, family, words)[at]
                    if w > k:
                        at, value = least_of_windows(at, value, value, owner, w - k + 1, False, partial)
                    row = pa.array(owner[at] + first)
                    columns = [pa.array(np.full(len(at), k, np.int32)), pa.array(at - begin[owner[at]]), pa.array(value.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], *columns], [*keys, "k", "pos", "hash"])

    return _keyed(df, keys, seq).mapInArrow(kernel, _types(df, keys) + "k int, pos long, hash long")


def rolling(df: DataFrame, k: int, w: int = 0, keys: Sequence[str] = ("id",), seq: str = "seq", family: str = "strand_free", alphabet_name: str = "DNA4", seed: int = 137, partial: bool = False) -> DataFrame:
    """keys, pos, hash: rolling_set() for one k."""
    return rolling_set(df, [k], w, keys, seq, family, alphabet_name, seed, partial).drop("k")


def rolling_sums(df: DataFrame, ks: Sequence[int], key: str = "id", seq: str = "seq", family: str = "strand_free", alphabet_name: str = "DNA4", seed: int = 137, modulus: int = 1_000_003) -> DataFrame:
    """key, k, hashes, kinds, residues of rolling_set(): how many hashes a key has, how many distinct ones, and the sum of their remainders.

    A row whose key no other row has is summed up in the kernel, so its hashes never leave the worker. The keys are counted
    first, which moves keys alone; only rows of a repeated key are summed up by a shuffle of their distinct hashes.
    """
    n, kinds, nulls = df.agg(F.count(F.lit(1)), F.count_distinct(key), F.count_if(F.col(key).isNull())).first()
    if n == kinds + min(nulls, 1):
        return _rolled_up(df, ks, key, seq, family, alphabet_name, seed, modulus)
    again = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_key")), "repeated")
    repeated = F.col(key).eqNullSafe(F.col("_key"))
    once = _rolled_up(join_checked(df, again, repeated, "left_anti"), ks, key, seq, family, alphabet_name, seed, modulus)
    rows = rolling_set(join_checked(df, again, repeated, "left_semi"), ks, 0, [key], seq, family, alphabet_name, seed)
    plain = F.col("hash").cast("decimal(20,0)")
    unsigned = F.when(plain < 0, plain + F.expr(f"{1 << 64}BD")).otherwise(plain)
    sums = rows.groupBy(key, "k").agg(F.count(F.lit(1)).alias("hashes"), F.count_distinct("hash").alias("kinds"), F.sum((unsigned % modulus).cast("long")).alias("residues"))
    return once.unionByName(sums)


def _rolled_up(df: DataFrame, ks: Sequence[int], key: str, seq: str, family: str, alphabet_name: str, seed: int, modulus: int) -> DataFrame:
    """rolling_sums() of each row for itself."""
    _check_family(family, alphabet_name)
    ks = list(ks)

    def kernel(batches):
        one = alphabet(alphabet_name)
        lut, words = one.lut(), hashes.table(seed, max(one.base, 4))
        for batch in batches:
            for first, codes, owner, _ in joined(batch.column(1).to_pylist(), lut):
                safe = np.maximum(codes, 0)
                for k in ks:
                    at = np.flatnonzero(clean_windows(codes, owner, k))
                    if not len(at):
                        continue
                    value = _hash_of(safe, k, family, words)[at]
                    begin = np.flatnonzero(np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]]))
                    end = np.append(begin[1:], len(at))
                    for a, b in zip(begin.tolist(), end.tolist()):
                        value[a:b].sort()
                    new = np.concatenate([[True], value[1:] != value[:-1]])
                    new[begin] = True
                    sums = np.full(len(begin), k, np.int32), end - begin, np.add.reduceat(new.astype(np.int64), begin), np.add.reduceat((value % np.uint64(modulus)).astype(np.int64), begin)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at[begin]] + first)), *map(pa.array, sums)], [key, "k", "hashes", "kinds", "residues"])

    return _keyed(df, [key], seq).mapInArrow(kernel, _types(df, [key]) + "k int, hashes long, kinds long, residues long")


def score_minimizers(df: DataFrame, seed: Seed, scores: DataFrame, keys: Sequence[str] = ("id",), seq: str = "seq") -> DataFrame:
    """keys, kmer: distinct minimizers whose score is looked up in scores (kmer, score); a k-mer without one is an error.

    The join is by k-mer; windows are then ranges of neighbouring positions, partitioned by sequence and block so that a
    long sequence is no single task: each block also gets the window before it.
    """
    from pyspark.sql import Window

    keys = list(keys)
    m = seed.window
    plain = Seed(seed.k, 0, seed.gaps, seed.canonical, seed.alphabet)
    rows = kmers(df, plain, keys, seq).join(scores.select("kmer", "score"), "kmer", "left")
    rows = rows.withColumn("score", F.coalesce("score", F.raise_error("a k-mer has no score").cast("long")))
    size = max(4 * m, 1 << 16)
    block = F.floor(F.col("pos") / size)
    # a seed is in its own block and, near a block's start, also ends windows of the block before
    spread = rows.withColumn("block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("pos") + m - 1) / size)))))
    frame = Window.partitionBy(*keys, "block").orderBy("pos").rangeBetween(-(m - 1), 0)
    full = F.count(F.lit(1)).over(frame) == m
    best = F.min(F.struct("score", "kmer")).over(frame)["kmer"]
    return spread.withColumns({"full": full, "best": best}).filter(F.col("full") & (block == F.col("block"))).select(*keys, F.col("best").alias("kmer")).distinct()
