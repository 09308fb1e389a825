"""Exact and near dedup against brute force."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup as E
from strandloom.llm import simhash as S

from .conftest import ODD


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max([x for x in ids if x is not None], default=None)
        stays = ids.index(best) if best in ids else 0
        out += [(x, best, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for k, x in enumerate(ids)]
    return Counter(out)


def test_exact_groups(odd, clash, none, table):
    want = brute_exact(ODD)
    for docs in (odd, clash):
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_groups(docs).collect()) == want
    assert E.exact_groups(none).count() == 0
    rnd = random.Random(1)
    base = ["".join(rnd.choices("abcDEF \n", k=rnd.choice([10, 900, 5000, 40000]))) for _ in range(12)]
    rows = [(i, rnd.choice([str.upper, str.lower, str])(rnd.choice(base))) for i in range(80)]
    rows += [(100 + i, b[:-1] + "!") for i, b in enumerate(base)]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_groups(table(rows)).collect()) == brute_exact(rows)


def test_dedup_keeps_columns_and_one_of_each(odd, clash):
    for docs in (odd, clash):
        out = E.dedup_exact(docs)
        assert out.columns == docs.columns
        got = Counter(lower(r.text) for r in out.collect())
        assert got == Counter({lower(t) for _, t, *_ in ODD})


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60_000), st.binary(min_size=1, max_size=40))
def test_chunks_cover_and_follow_content(data, head):
    for x in (data, head * 3000, head + data):
        ends = E.cuts(x)
        sizes = [j - i for i, j in zip([0, *ends], ends)]
        assert (ends[-1] if ends else 0) == len(x) and all(0 < s <= E.MOST for s in sizes) and all(s >= E.LEAST for s in sizes[:-1])


def test_chunks_meet_again_after_an_insertion():
    rnd = random.Random(3)
    data = bytes(rnd.choices(range(97, 123), k=80_000))
    a, b = ({x[i:j] for i, j in zip([0, *E.cuts(x)], E.cuts(x))} for x in (data, b"inserted text " + data))
    assert len(a & b) >= 0.8 * len(a)


def test_shared_digests_are_found(table, monkeypatch):
    """Digests that clash under the first two keys: the recipes are made anew until none do, and no texts are confused."""
    rows = [(1, "one text"), (2, "another text"), (3, "one text"), (4, ""), (5, "One Text")]
    docs = E.Located(table(rows)).select(doc_id=F.col("doc_id"), text=F.col("text"))
    asked = []

    def weak(chunk, key, strong=E.digest):
        return strong(b"same" if key < 2 else chunk, key)

    real = E.clashes
    monkeypatch.setattr(E, "clashes", lambda *a: asked.append((a[1], real(*a))) or asked[-1][1])
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.verdicts(docs, weak).collect())
    assert asked == [(0, 1), (1, 1), (2, 0)] and got == brute_exact(rows)
    with pytest.raises(RuntimeError):
        E.verdicts(docs, lambda chunk, key: b"x" * 16)


def brute_fingerprint(text):
    words = lower(text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "cc", " ", "\n", "\x0b", " ", "dd "]), max_size=40))
def test_fingerprints(parts):
    assert S.fingerprint("".join(parts)) == brute_fingerprint("".join(parts))


def brute_components(fps):
    left, out = set(fps), {}
    while left:
        seed = [left.pop()]
        group = set(seed)
        while seed:
            x = seed.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            group |= near
            seed += near
        out |= {x: group for x in group}
    return out


@pytest.mark.parametrize("task_rows,leaf,frontier", [(1 << 18, 16, 1 << 18), (1 << 18, 1, 7), (12, 4, 100)])
def test_trie_join(spark, monkeypatch, task_rows, leaf, frontier):
    monkeypatch.setattr(S, "TASK_ROWS", task_rows)
    rnd = random.Random(8)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 12)):
            fps.add(x)
            x ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.4:
                x ^= 1 << rnd.randrange(64)
    fps |= {rnd.getrandbits(64) for _ in range(150)}
    signed = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    rows = spark.createDataFrame([(0, x, x, b"") for x in signed], "trie int, code long, node long, print binary")
    found = S.components(S.links(rows.select("trie", "code"), rows, 2, 64, first=4))
    roots = {r.node: r.root for r in found.collect()}
    mask = 2**64 - 1
    for x, group in brute_components(fps).items():
        signed_group = [y - 2**64 if y >= 2**63 else y for y in group]
        mine = x - 2**64 if x >= 2**63 else x
        assert roots.get(mine, mine) == min(signed_group), (x & mask, len(group))
    one = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "FRONTIER", frontier)
    pairs = [(int(a), int(b)) for i, j in S.trie_links(one, one, 0, 0, True) for a, b in zip(i, j)]
    assert sorted(pairs) == [(i, j) for i in range(len(one)) for j in range(i + 1, len(one)) if int(one[i] ^ one[j]).bit_count() <= 2]
    low, high = one[one < 1 << 63], one[one >= 1 << 63]
    pairs = [(int(a), int(b)) for i, j in S.trie_links(low, high, 1, 1, False) for a, b in zip(i, j)]
    assert sorted(pairs) == [(i, j) for i in range(len(low)) for j in range(len(high)) if int(low[i] ^ high[j]).bit_count() <= 2]


def test_a_dense_group_keeps_a_forest_only():
    rnd = random.Random(2)
    forest, n = S.Forest(3000), 3000
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(n) for b in rnd.sample(range(n), 40)]))
    forest.add(i, j)
    assert len(forest.links) == n - 1 and len({forest.root(x) for x in range(n)}) == 1


def test_bit_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 64, 65, 1000, 5001):
        x = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        want = [sum(int(r) >> b & 1 for r in x[:, w]) for w in range(3) for b in range(64)]
        assert S.bit_counts(x).tolist() == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999), (999, 998), (1000, 998)], "u long, v long")
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert all(roots.get(i, i) == 0 for i in range(201)) and roots[1000] == roots[999] == 998


def test_near_groups(odd, clash, none):
    fps = [brute_fingerprint(t) for _, t, *_ in ODD]
    near = brute_components(fps)
    want = Counter()
    for (i, *_), f in zip(ODD, fps):
        ids = [j for (j, *_), g in zip(ODD, fps) if g in near[f] and j is not None]
        want[(i, f"{f:016x}", min(ids) if ids else None)] += 1
    for docs in (odd, clash):
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.near_groups(docs).collect()) == want
    assert S.near_groups(none).count() == 0


def brute_near(rows):
    """The ids that stay, from all pairs of long fingerprints; and pairs of ids with the similarity of their shingles."""
    prints = {i: int.from_bytes(S.long_fingerprint(t), "little") for i, t in rows}
    group = {i: {i} for i in prints}
    for i in prints:
        for j in prints:
            if i < j and group[i] is not group[j] and (prints[i] ^ prints[j]).bit_count() <= 77:
                group[i] |= group[j]
                for x in group[j]:
                    group[x] = group[i]
    return group


def shingle_sets(rows):
    words = {i: lower(t).encode().split() for i, t in rows}
    return {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}


def near_rows():
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for _ in range(60):
        text = rnd.choices(words, k=rnd.randrange(20, 400))
        for _ in range(rnd.randrange(1, 5)):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rnd.randrange(1, 2 + len(text) // 40)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
    hot = rnd.choices(words, k=200)
    for k in range(90):  # over a third of all rows are near copies
        rows.append((len(rows), " ".join(hot[:k] + ["x" + str(k)] + hot[k:])))
    return rows


@pytest.mark.parametrize("task_rows", [1 << 18, 40])
def test_similar_texts_go(table, monkeypatch, task_rows):
    monkeypatch.setattr(S, "TASK_ROWS", task_rows)
    rows = near_rows()
    group = brute_near(rows)
    want = sorted({min(g) for g in group.values()})
    assert len(want) < len(rows) - 100
    assert sorted(r.doc_id for r in S.dedup_near(table(rows)).collect()) == want
    sets = shingle_sets(rows)
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    sure = [p for p, s in alike.items() if s >= 0.9]
    assert sure and all(group[i] is group[j] for i, j in sure)
    assert S.limit_of(0.8, 512) == 77 and S.SEGMENTS * (S.SEGMENT_BUDGET + 1) > 77


def noisy_prints(rnd, groups, differ):
    """Fingerprints in chains whose neighbours differ in so many bits."""
    out = []
    for _ in range(groups):
        x = rnd.getrandbits(512)
        for _ in range(rnd.randrange(1, 5)):
            out.append(x)
            for b in rnd.sample(range(512), rnd.choice(differ)):
                x ^= 1 << b
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("many,at_once", [(16, 1 << 14), (2, 5)])
def test_links_of_blocks(monkeypatch, many, at_once):
    """Of one block, and of one with another: joined is what all pairs join, up to the last bit and in dense groups."""
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    rnd = random.Random(5)
    dense = rnd.getrandbits(512)
    for prints in (noisy_prints(rnd, 60, (76, 77, 78)), noisy_prints(rnd, 60, (1, 30, 90)), [dense ^ (1 << b) for b in range(100)] + noisy_prints(rnd, 20, (77,)), [dense]):
        words = np.frombuffer(b"".join(x.to_bytes(64, "little") for x in prints), "<u8").reshape(-1, 8)
        for ahead in (None, 0, len(prints) // 3, len(prints)):
            want, got = S.Forest(len(prints)), S.Forest(len(prints))
            pairs = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 77]
            for i, j in pairs:
                if ahead is None or i < ahead <= j:
                    want.add(np.array([i]), np.array([j]))
            found = S.block_links(words, ahead, 77)
            for i, j in found:
                got.add(np.array([i]), np.array([j]))
            assert len(got.links) == len(found) and all((prints[i] ^ prints[j]).bit_count() <= 77 for i, j in found)
            if ahead is None:
                assert got.roots(np.arange(len(prints))).tolist() == want.roots(np.arange(len(prints))).tolist()
            else:  # rows that follow each other in one block may be joined too
                assert all(got.root(i) == got.root(j) for i, j in want.links)


def test_memory_of_a_task_follows_its_rows():
    """Not the pairs that it looks at: here all fingerprints agree in one segment, and none are similar."""
    rng = np.random.default_rng(7)
    words = np.frombuffer(b"".join(b"same" + rng.bytes(60) for _ in range(4000)), "<u8").reshape(-1, 8)
    for ahead in (None, 2000):
        tracemalloc.start()
        assert not S.block_links(words, ahead, 77)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 3 * 8 * (1 << 20) + 1000 * len(words)  # three tables by code, and the rows'


def test_a_task_holds_two_blocks(spark):
    """Each pair of blocks is one partition, and a fingerprint moves once for each block, however many share a segment."""
    rng = np.random.default_rng(6)
    prints = [b"same" + rng.bytes(60) for _ in range(600)]
    rows = spark.createDataFrame([(int(np.frombuffer(rng.bytes(8), np.int64)[0]), p) for p in prints], "node long, print binary")
    found = S.block_pairs(rows, 5).groupBy(F.spark_partition_id().alias("part"), "a", "b").agg(F.sum(F.length("prints")).alias("bytes")).collect()
    assert sorted((r.a, r.b) for r in found) == [(a, b) for a in range(5) for b in range(a, 5)] and len({r.part for r in found}) == 15
    assert sum(r.bytes for r in found) == 5 * 600 * 64 and max(r.bytes for r in found) < 600 * 64 * 0.6
    assert S.blocks_for(0, 8) == 1 and S.blocks_for(10**9, 8) == -(-(10**9) * 2 // S.NEAR_ROWS) and S.blocks_for(200_000, 6) == 7


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_blocks_of_similar_texts(table, monkeypatch, most):
    monkeypatch.setattr(S, "NEAR_ROWS", most)
    rows = near_rows()
    want = sorted({min(g) for g in brute_near(rows).values()})
    assert sorted(r.doc_id for r in S.dedup_near(table(rows)).collect()) == want


def test_near_dedup_moves_less_than_its_segments(spark, table):
    """A fingerprint that moved with each of its 26 segments took more disk than the texts on larger tables."""
    rnd = random.Random(12)
    docs = table([(i, " ".join(rnd.choices("abcdefghij", k=30))) for i in range(1500)])
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = sent()
    assert S.dedup_near(docs).count() > 1400
    time.sleep(1)  # the listener follows
    assert sent() - before < 1500 * 64 * 13


def test_estimate_of_similarity():
    """Differing bits of pairs of texts stand for their similarity, within a few standard errors."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(2000)]
    for share in (0.5, 0.8, 0.95):
        off = []
        for _ in range(20):
            whole = rnd.choices(words, k=600)
            cut = int(600 * share)
            a, b = " ".join(whole), " ".join(whole[:cut] + rnd.choices(words, k=600 - cut))
            x, y = (shingle_sets([(0, t)])[0] for t in (a, b))
            bits = (int.from_bytes(S.long_fingerprint(a), "little") ^ int.from_bytes(S.long_fingerprint(b), "little")).bit_count()
            off.append(bits - S.limit_of(len(x & y) / len(x | y), 512))
        assert abs(np.mean(off)) < 8 and np.std(off) < 14


def test_near_dedup_of_odd_rows(odd, clash, none):
    for docs in (odd, clash):
        out = S.dedup_near(docs)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == [1, 3, 6, 8]
    assert S.dedup_near(none).count() == 0


def test_rows_are_dropped_where_they_are_read(spark, table, odd):
    """By bitmaps, in one broadcast or one for each group of files; repeated rows are told apart; a plan is written first."""
    docs = table([(i, f"t{i % 7}") for i in range(200)] + [(5, "t5")] * 3, parts=5)
    want = Counter(r.doc_id for r in docs.collect() if r.doc_id % 3)
    for source in (docs, docs.filter("doc_id >= 0"), docs.withColumn("at_file", F.lit(1)).withColumn("bits", F.lit(2)).withColumn("_metadata", F.lit(3))):
        at = E.Located(source)
        verdict = at.select(doc_id=F.col("doc_id")).withColumn("kept", F.col("doc_id") % 3 != 0)
        for most in (1 << 20, 5000):
            out = at.keep(verdict, most)
            assert out.columns == source.columns and Counter(r.doc_id for r in out.collect()) == want
    at = E.Located(docs)
    one = at.select(doc_id=F.col("doc_id")).filter("doc_id = 5").orderBy("at_file", "at_place").limit(1).withColumn("kept", F.lit(False))
    assert at.keep(one).filter("doc_id = 5").count() == 3 and at.keep(one.limit(0)).count() == 203
