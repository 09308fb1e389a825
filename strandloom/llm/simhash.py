"""SimHash near-dedup by a self-join of binary tries of fingerprints.

Distinct fingerprints form a trie. Pairs of its nodes are traversed together: a pair's differing bits add up on the way
down, and a pair is dropped when they exceed the error budget or one side is empty. The upper part runs on a table of
nodes and how many fingerprints each holds, a few bits a step; fingerprints meet a node pair only where it has become small
enough for one task, which goes on bit by bit with all node pairs of a level at once. A task returns a spanning
forest of the links it finds, which is what components need, so a dense group never yields all of its pairs. Components are
joined by alternating stars.

A short fingerprint is one trie (op6: 64 bits, budget 2). A similarity of 0.8 needs more bits than one trie can search, so
`dedup_near` takes 512 of them as 26 segments: texts within 77 differing bits agree within 2 bits in one of the segments,
so the segments together lose none. 77 bits are what a similarity of 0.8 gives. Here the fingerprints are dealt to blocks,
and each pair of blocks is one task: it goes through all segments, looks up the codes within 2 bits of each code, and
compares the whole fingerprints of what it finds. So a fingerprint is moved once for each block, whatever the number of
segments, and a task holds two blocks at most, however alike the texts are. The estimate's standard error is 0.04.

Defined results. Null or empty text: fingerprint zero, linked as any other. Null doc_id: grouped, never a component's id
unless it has no other. Repeated rows: rows of their own, of which dedup_near keeps one. Texts of fewer words than a
shingle: one shingle of all words. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, count, product, repeat
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Located, drop, join_checked, join_groups, map_arrow, written
from .exact_dedup import normal_bytes

WIDTH, BUDGET, SEED = 3, 2, 42
#: The pipeline's near-dedup: words of a shingle, least similarity, and the segments of the long fingerprint.
NEAR_WIDTH, NEAR_LEAST, LONG_BITS, SEGMENTS, SEGMENT_BUDGET = 5, 0.8, 512, 26, 2
#: Most long fingerprints in one task, of two blocks together; blocks are smaller where that gives the cores a few tasks each, but for so few.
NEAR_ROWS, NEAR_FEWEST = 1 << 19, 1 << 12
#: So many fingerprints of one code are first joined along their order, and left out where they are joined already.
MANY = 16
#: Fingerprints of a block that are looked up at once, so that what they meet stays in a core's cache.
AT_ONCE = 1 << 14
#: Bits that a step of the upper traversal goes down, and the most fingerprints of a node pair's sides together in one task.
STEP, TASK_ROWS = 4, 1 << 18
#: A node pair is compared outright from so many pairs of fingerprints down; node pairs that a task holds at once.
LEAF, FRONTIER = 16, 1 << 18
#: Odd 64-bit multipliers (the golden ratio, and those of a published finalizer).
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of `width` lowered words, repeats included; of the whole sequence if it is shorter."""
    words = normal_bytes(text).split()  # bytes split at the six ASCII white-space characters
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    pieces = map(joined.__getitem__, map(slice, starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n - width + 1)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of words (rows, 64-bit words). Rows are added three at a time, bit by bit."""
    total = np.zeros(64 * words.shape[1], np.int64)
    weight = 1
    while len(words) > 64:
        carries = []
        while len(words) > 8:
            m = len(words) // 3
            a, b, c = words[:m], words[m : 2 * m], words[2 * m : 3 * m]
            some = a ^ b
            carries.append((a & b) | (some & c))
            words = np.concatenate([some ^ c, words[3 * m :]])
        total += weight * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries)
        weight *= 2
    return total + weight * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    bits = np.packbits(2 * bit_counts(hashes[:, None]) > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def long_fingerprint(text: str | None, width: int = NEAR_WIDTH, bits: int = LONG_BITS) -> bytes:
    """As fingerprint(), over the distinct shingles and with as many bits as asked for, drawn from each one's hash."""
    hashes = np.unique(shingle_hashes(text, width))
    total = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        x = hashes[at : at + (1 << 15), None] + _GOLD * np.arange(1, bits // 64 + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        total += bit_counts(x ^ (x >> np.uint64(31)))
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def segment_ends(bits: int = LONG_BITS, n: int = SEGMENTS) -> list[int]:
    return [bits * (i + 1) // n for i in range(n)]


def segment_codes(words: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The bits from begin to end of fingerprints (rows of 64-bit words) as numbers."""
    at, shift = divmod(begin, 64)
    code = words[:, at] >> np.uint64(shift)
    if shift + end - begin > 64:
        code |= words[:, at + 1] << np.uint64(64 - shift)
    return (code & np.uint64((1 << (end - begin)) - 1)).astype(np.int64)


def limit_of(least: float, bits: int) -> int:
    """Most differing bits: sets of similarity s have shingle vectors at a cosine of 2s / (1 + s), or more if their sizes differ."""
    return int(bits * acos(2 * least / (1 + least)) / pi)


class Trie:
    """Sorted distinct codes of one node, and how many of their first have a one at each bit."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits, self.known = codes, bits, {}

    def ones(self, depth: int) -> np.ndarray:
        if depth not in self.known:
            bit = (self.codes >> np.uint64(self.bits - 1 - depth)) & np.uint64(1)
            self.known[depth] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
        return self.known[depth]


def trie_links(left: np.ndarray, right: np.ndarray, depth: int, used: int, same: bool, budget: int = BUDGET, bits: int = 64):
    """Index pairs (two arrays at a time) of sorted arrays of unsigned codes that differ in at most `budget` bits.

    All of `left` share their first `depth` bits, all of `right` theirs, and these differ in `used` bits. same: both
    are one node, and each pair is found once.
    """
    a_side = Trie(left, bits)
    b_side = a_side if same else Trie(right, bits)
    first = [np.array([x], np.int32) for x in (0, len(left), 0, len(right))]
    stack = [(depth, *first, np.array([used], np.int8), np.array([same]))]
    while stack:
        depth, a, b, c, d, used, own = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *[x[half:] for x in (a, b, c, d, used, own)]), (depth, *[x[:half] for x in (a, b, c, d, used, own)])]
            continue
        size = (b - a).astype(np.int64) * (d - c)
        leaf = (size <= LEAF) | (depth == bits)
        if leaf.any():
            yield from compared(left, right, a[leaf], c[leaf], (d - c)[leaf], size[leaf], own[leaf], budget)
            a, b, c, d, used, own = (x[~leaf] for x in (a, b, c, d, used, own))
        if not len(a):
            continue
        ones, others = a_side.ones(depth), b_side.ones(depth)
        e, f = b - (ones[b] - ones[a]), d - (others[d] - others[c])  # where the ones begin
        free = used < budget
        parts = [(a, e, c, f, used, own), (e, b, f, d, used, own), *[tuple(x[free] for x in (a, e, f, d, used + 1, np.zeros(len(a), bool)))]]
        cross = free & ~own  # of one node's halves, each pair stands in the third part already
        parts.append(tuple(x[cross] for x in (e, b, c, f, used + 1, own)))
        a, b, c, d, used, own = (np.concatenate(x) for x in zip(*parts))
        some = (a < b) & (c < d) & ~(own & (b - a == 1))
        stack.append((depth + 1, *[x[some] for x in (a, b, c, d, used, own)]))


def compared(left, right, a, c, width, size, own, budget):
    """All pairs of the ranges that begin at a and c, some millions at a time, by their codes."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), side="right")))
        n = size[at:to]
        whole = int(n.sum())
        k = np.arange(whole) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(width[at:to], n)
        row, column = np.divmod(k, w) if whole < 1 << 31 else (k // w, k % w)
        i, j = np.repeat(a[at:to], n) + row, np.repeat(c[at:to], n) + column
        good = np.bitwise_count(left[i] ^ right[j]) <= budget
        good &= ~np.repeat(own[at:to], n) | (i < j)
        yield i[good], j[good]
        at = to


class Forest:
    """Trees of numbered items, joined by links."""

    def __init__(self, size: int):
        self.parent = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.parent[x]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keeps the links that join two trees, in order."""
        while len(i):
            now, later = (i[:4096], j[:4096]), (i[4096:], j[4096:])
            for x, y in zip(*(v.tolist() for v in now)):
                p, q = self.root(x), self.root(y)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    self.links.append((x, y))
            apart = self.roots(later[0]) != self.roots(later[1]) if len(later[0]) else np.zeros(0, bool)
            i, j = later[0][apart], later[1][apart]


def pair_task(bits: int, budget: int, most: int):
    """What a task does with the rows of one node pair: links that join what all its links join.

    Rows are side, code, node and print; links need at most `budget` bits between codes and, if prints are not empty, at most
    `most` between these.
    """

    def leaf(key, table):
        a, b, depth = (key[i].as_py() for i in (1, 2, 3))
        side, code, node = (table[c].to_numpy() for c in ("side", "code", "node"))
        code = code.view(np.uint64)
        order = np.lexsort((node, code, side))
        side, code, node = side[order], code[order], node[order]
        ahead = 0 if a == b else int(np.count_nonzero(side == 0))
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(len(order), -1)[order]
        left, right = (code, code) if a == b else (code[:ahead], code[ahead:])
        forest = Forest(len(order))
        for i, j in trie_links(left, right, depth, (a ^ b).bit_count(), a == b, budget, bits):
            j = j + ahead
            if prints.shape[1] and len(i):
                near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int32) <= most
                i, j = i[near], j[near]
            forest.add(i, j)
        i, j = (np.array(x, dtype=np.int64) for x in (zip(*forest.links) if forest.links else ((), ())))
        return pa.table({"u": np.maximum(node[i], node[j]), "v": np.minimum(node[i], node[j])})

    return leaf


def prefix(code, bits: int, depth: int):
    """The first `depth` of a code's bits as a number."""
    return F.shiftrightunsigned(code, bits - depth) if depth else F.lit(0).cast("long")


def node_pairs(codes: DataFrame, bits: int, budget: int, first: int) -> list[tuple[int, DataFrame]]:
    """(depth, table of trie, a, b) of the node pairs that one task each will traverse; a <= b are the nodes' prefixes.

    codes: trie, code. Nodes with the numbers of their codes are all that moves here. first: the least depth of a task.
    """
    zero = F.lit(0).cast("long")
    open_ = codes.select("trie").distinct().select("trie", zero.alias("a"), zero.alias("b"))
    out = []
    depth, last = min(first, bits), 0
    while True:
        step = depth - last
        flips = sorted((m for m in range(1 << step) if m.bit_count() <= budget), key=int.bit_count)
        low = (1 << step) - 1
        nodes = written(codes.groupBy("trie", prefix(F.col("code"), bits, depth).alias("a")).agg(F.count(F.lit(1)).alias("n")), "nodes")
        up = open_.select("trie", F.shiftleft("a", step).alias("p"), F.shiftleft("b", step).alias("q"), (F.col("a") == F.col("b")).alias("own"))
        child = nodes.select("trie", F.col("a").bitwiseAND(~low).alias("p"), "a", "n")
        other = F.col("q") + F.col("a").bitwiseAND(low).bitwiseXOR(F.col("flip"))
        asked = up.join(child, ["trie", "p"]).withColumn("flip", F.explode(F.lit(flips).cast("array<long>"))).withColumn("b", other)
        asked = asked.filter((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget) & (~F.col("own") | (F.col("a") <= F.col("b"))))
        pairs = asked.join(nodes.select("trie", F.col("a").alias("b"), F.col("n").alias("m")), ["trie", "b"])
        own = F.col("a") == F.col("b")
        small = (F.col("n") + F.when(own, 0).otherwise(F.col("m")) <= TASK_ROWS) | F.lit(depth == bits)
        pairs = written(pairs.filter(~own | (F.col("n") > 1)).select("trie", "a", "b", small.alias("small")), "node-pairs", open_)
        drop(nodes)
        n_small, n_open = pairs.agg(F.count_if("small"), F.count_if(~F.col("small"))).first()
        if n_small:
            out.append((depth, written(pairs.filter("small").drop("small"), "tasks")))
        if not n_open:
            return out
        open_ = written(pairs.filter("NOT small").drop("small"), "open", pairs)
        depth, last = min(depth + STEP, bits), depth


def links(codes: DataFrame, rows: DataFrame, budget: int, bits: int, most: int = 0, first: int = 0) -> DataFrame:
    """u > v: links among the nodes of rows (trie, code, node, print) that join the same components as all links do.

    codes has the rows' trie and code alone. Nodes link if their codes in some trie differ in at most `budget` bits and, where
    prints are not empty, their prints in at most `most` bits. first: the least depth at which tasks begin; where there are few
    tries, some bits make them many.
    """
    found: DataFrame | None = None
    for depth, pairs in node_pairs(codes, bits, budget, first):
        own = rows.withColumn("at", prefix(F.col("code"), bits, depth))
        sides = [join_checked(own, p.withColumn("at", F.col(x)), ["trie", "at"], "inner").withColumn("side", F.lit(i)) for i, x, p in ((0, "a", pairs), (1, "b", written(pairs.filter("a <> b"), "others")))]
        both = sides[0].unionByName(sides[1]).select("trie", "a", "b", F.lit(depth).alias("depth"), "side", "code", "node", "print")
        some = written(both.groupBy("trie", "a", "b", "depth").applyInArrow(pair_task(bits, budget, most), "u long, v long"), "links")
        found = some if found is None else found.unionByName(some)
    return found if found is not None else rows.sparkSession.createDataFrame([], "u long, v long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root of every node in links u > v: root is its component's smallest node. Alternating large and small stars."""
    now = written(edges.distinct(), "stars")
    seen = None
    for _ in range(most):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        now = written(small.distinct(), "stars", now)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed) of every row."""

    def kernel(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), kernel, "doc_id long, fp long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint, component_id of every row, by short fingerprints."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "distinct")
    one = distinct.select(F.lit(0).alias("trie"), F.col("fp").alias("code"), F.col("fp").alias("node"), F.lit(b"").alias("print"))
    named = written(components(links(one.select("trie", "code"), one, budget, 64, first=STEP)), "components")
    rooted = written(distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    chosen = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "chosen")
    groups = written(join_groups(rooted.select("fp", "n", "root"), chosen, "root", "nodes").drop("root", "nodes"), "groups")
    return join_groups(rows, groups, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def long_prints(texts: DataFrame, width: int) -> DataFrame:
    """texts (doc_id, text, at_file, at_place) with print and node, a hash of it, instead of text."""

    def kernel(batches):
        for batch in batches:
            got = [long_fingerprint(t, width) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(nodes), pa.array(got, pa.binary())], ["doc_id", "at_file", "at_place", "node", "print"])

    return map_arrow(texts, kernel, "doc_id long, at_file long, at_place long, node long, print binary")


class Side:
    """The rows of fingerprints from `first` to `last` in the order of a segment's codes, and three words apart from the segment."""

    def __init__(self, words: np.ndarray, first: int, last: int, begin: int, end: int):
        code = segment_codes(words[first:last], begin, end)
        order = np.argsort(code)
        self.code, self.row = code[order], order + first
        self.some = [words[first:last, ((end - 1) // 64 + k) % words.shape[1]][order] for k in (1, 2, 3)]


def block_links(words: np.ndarray, ahead: int | None, most: int) -> list[tuple[int, int]]:
    """Links (row numbers) that join what all links of the first `ahead` rows to the others join; None: of all rows to each other.

    words: fingerprints as rows of 64-bit words; they link if they differ in at most `most` bits.
    """
    forest = Forest(len(words))
    seen, roots = 0, forest.parent.copy()

    def link(x: Side, i: np.ndarray, y: Side, j: np.ndarray) -> None:
        differ = np.bitwise_count(x.some[0][i] ^ y.some[0][j])
        for p, q in zip(x.some[1:], y.some[1:]):
            differ += np.bitwise_count(p[i] ^ q[j])  # 192 at most
        maybe = differ <= most
        u, v = x.row[i[maybe]], y.row[j[maybe]]
        apart = forest.roots(u) != forest.roots(v) if len(u) else maybe[:0]
        u, v = u[apart], v[apart]
        near = np.bitwise_count(words[u] ^ words[v]).sum(axis=1, dtype=np.int32) <= most
        forest.add(u[near], v[near])

    for begin, end in zip([0, *segment_ends()], segment_ends()):
        a = Side(words, 0, len(words) if ahead is None else ahead, begin, end)
        b = a if ahead is None else Side(words, ahead, len(words), begin, end)
        counts = np.bincount(b.code, minlength=1 << (end - begin))
        there = counts > 0
        start = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=start[1:])
        if counts.max() >= MANY:
            j = np.flatnonzero((b.code[1:] == b.code[:-1]) & (counts[b.code[1:]] >= MANY))
            link(b, j, b, j + 1)
        flips = [sum(1 << x for x in bits) for n in range(SEGMENT_BUDGET + 1) for bits in combinations(range(end - begin), n)]
        for at, flip in product(range(0, len(a.code), AT_ONCE), flips):
            code = a.code[at : at + AT_ONCE]
            other = code ^ flip
            hit = there[other]
            if a is b and flip:
                hit &= other > code
            i = np.flatnonzero(hit)
            other = other[i]
            i, j, last = i + at, start[other], start[other + 1]
            if a is b and not flip:
                j = i + 1
                i, j, last = (x[j < last] for x in (i, j, last))
            step = 0
            while len(i):  # each row meets the first of its run, then each the second, and so on
                if (step == 1 or step % MANY == 0) and (long := last - j >= MANY).any():
                    if seen != len(forest.links):
                        seen, roots = len(forest.links), forest.roots(np.arange(len(words)))
                        forest.parent = roots.copy()
                    own = roots[b.row]
                    change = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))
                    joined = long & (roots[a.row[i]] == own[j]) & (change[np.searchsorted(change, j, side="right")] >= last)
                    i, j, last = (x[~joined] for x in (i, j, last))
                link(a, i, b, j)
                j, step = j + 1, step + 1
                i, j, last = (x[j < last] for x in (i, j, last))
    return forest.links


def blocks_for(rows: int, cores: int) -> int:
    """Among how many blocks so many fingerprints are dealt."""
    enough = next(b for b in count(1) if b * (b + 1) // 2 >= 4 * cores)
    return max(1, -(-2 * rows // NEAR_ROWS), min(enough, rows // NEAR_FEWEST))


def block_pairs(distinct: DataFrame, blocks: int) -> DataFrame:
    """a, b, side, prints: of every pair a <= b of blocks the fingerprints of a (side 0) and b (1), many to a row; a partition each."""

    def kernel(batches):
        for batch in batches:
            block = batch.column(0).to_numpy().view(np.uint64) % np.uint64(blocks)
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, LONG_BITS // 8)
            which = np.unique(block)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([prints[block == k].tobytes() for k in which], pa.binary())], ["block", "prints"])

    rows = map_arrow(distinct.select("node", "print"), kernel, "block int, prints binary").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = rows.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).cast("int").alias("side"), "prints")
    return pairs.repartitionById(blocks * (blocks + 1) // 2, (F.col("b") * (F.col("b") + 1) / 2 + F.col("a")).cast("int"))


def near_links(distinct: DataFrame, most: int) -> DataFrame:
    """u > v: links among the nodes of distinct (node, print) that join what all prints within `most` bits of each other join."""

    def kernel(batches):
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            for a, b, side, prints in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault((a, b), ([], []))[side].append(prints)
        for a, b in list(held):
            sides = held.pop((a, b))
            ahead = None if a == b else sum(map(len, sides[0])) * 8 // LONG_BITS
            words = np.frombuffer(b"".join(sides[0] + sides[1]), "<u8").reshape(-1, LONG_BITS // 64)
            del sides
            ends = np.array(block_links(words, ahead, most), np.int64).reshape(-1, 2)
            nodes = [np.array([xxhash.xxh64_intdigest(words[i].tobytes(), SEED) for i in x], np.uint64).view(np.int64) for x in ends.T.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*nodes)), pa.array(np.minimum(*nodes))], ["u", "v"])

    blocks = blocks_for(distinct.count(), distinct.sparkSession.sparkContext.defaultParallelism)
    return map_arrow(block_pairs(distinct, blocks), kernel, "u long, v long")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, least: float = NEAR_LEAST) -> DataFrame:
    """docs with one row of each component of similar texts, columns as they were: the one with the smallest doc_id.

    similar: the long fingerprints differ in no more bits than a similarity of `least` gives, which is estimated so.
    """
    most = limit_of(least, LONG_BITS)
    if most >= SEGMENTS * (SEGMENT_BUDGET + 1):
        raise ValueError("the segments' budgets do not cover so low a similarity")
    at = Located(docs)
    rows = written(long_prints(at.select(doc_id=F.col(id_col).cast("long"), text=F.col(text_col)), width), "prints")
    top = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "at_file", "at_place")
    distinct = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(top).alias("top"), F.first("print").alias("print")), "distinct")
    named = written(components(written(near_links(distinct, most), "links")), "components")
    rooted = written(distinct.drop("print").join(named, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    best = rooted.groupBy("root").agg(F.min("top").alias("best"), F.count(F.lit(1)).alias("nodes"))
    chosen = written(best.select("root", "nodes", F.col("best.at_file").alias("keep_file"), F.col("best.at_place").alias("keep_place")), "chosen")
    groups = written(join_groups(rooted.select("node", "n", "root"), chosen, "root", "nodes").drop("root", "nodes"), "groups")
    kept = (F.col("at_file") == F.col("keep_file")) & (F.col("at_place") == F.col("keep_place"))
    return at.keep(join_groups(rows.drop("print"), groups, "node", "n").select("at_file", "at_place", kept.alias("kept")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
