"""Set similarity, exact and sketched."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import sets as A
from strandloom.operators import similarity as U


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(1)
    pool = range(4000)
    return {g: set(rnd.sample(pool, 900)) if g != "d" else {10**6} for g in "abcd"}


@pytest.fixture(scope="module")
def sets(spark, groups):
    return spark.createDataFrame([(g, k) for g, v in groups.items() for k in v], "g string, kmer long").cache()


def test_all_pairs(sets, groups):
    got = {(r.i, r.j): (r.inter, r.uni, r.jaccard) for r in U.all_pairs(sets, "g", zeros=True).collect()}
    want = {(i, j): (len(groups[i] & groups[j]), len(groups[i] | groups[j]), len(groups[i] & groups[j]) / len(groups[i] | groups[j])) for i in groups for j in groups if i < j}
    assert got == want
    near = U.nearest(U.all_pairs(sets, "g", zeros=True), 2).collect()
    assert {r.item for r in near} == set("abcd") and all(r.item != r.neighbor for r in near) and len(near) == 8


def test_condensed_index(spark):
    n = 5
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)], "i long, j long")
    got = [r.p for r in pairs.orderBy("i", "j").select(U.condensed_index(F.col("i"), F.col("j"), F.lit(n)).alias("p")).collect()]
    assert got == list(range(10))


def test_bottom_k(sets, groups):
    sketch = U.bottom_k(sets, "g", 256)
    assert {r.g: r["count"] for r in sketch.groupBy("g").count().collect()} == {"a": 256, "b": 256, "c": 256, "d": 1}
    for r in U.bottom_k_jaccard(sketch, "g", 256).collect():
        true = len(groups[r.i] & groups[r.j]) / len(groups[r.i] | groups[r.j])
        assert abs(r.jaccard - true) < 0.1


def test_sketches(sets, groups):
    for r in U.hll_cardinality(U.hll(sets, ["g"], 12), ["g"]).collect():
        assert abs(r.n - len(groups[r.g])) <= 2 * 1.04 / 64 * len(groups[r.g]) + 1
    pairs = U.candidates(U.bottom_k(sets, "g", 256), "g")
    assert pairs.count() == 3 and U.all_pairs(sets, "g").count() == 3 and len(U.matrix(U.all_pairs(sets, "g")).columns) == 3
    for r in U.theta_jaccard(U.theta(sets, ["g"]), pairs, "g").collect():
        true = len(groups[r.i] & groups[r.j]) / len(groups[r.i] | groups[r.j])
        assert abs(r.jaccard - true) < 0.08


def test_quantized(spark):
    rows = spark.createDataFrame([(0.5,), (0.25,), (1e-9,), (8.0,)], "x double").select(U.quantized(F.col("x"), 1.0, 2.0, 20).alias("q")).collect()
    assert [r.q for r in rows] == [2, 3, 20, 0]


def test_weighted(spark):
    counts = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 1, 1), ("b", 3, 2)], "g string, kmer long, n long")
    assert [tuple(r) for r in U.weighted_jaccard(counts, "g").collect()] == [("a", "b", 1 / 6)]


def test_equal_sets_are_one_class(spark):
    rows = [(f"x{i:02}", h) for i in range(30) for h in range(50)] + [("y", h) for h in range(2, 52)] + [("z", h) for h in range(1000, 1050)]
    pairs, member = U.banded(spark.createDataFrame(rows, "g string, hash long"), "g", 8, 2)
    assert {r.g: r["class"] for r in member.collect()} == {f"x{i:02}": "x00" for i in range(30)} | {"y": "y", "z": "z"}
    assert [(r.i, r.j) for r in pairs.collect()] == [("x00", "y")]


def test_recall_of_nearest_classes(spark):
    """Against all pairs by brute force: the share of neighbours of a similarity of 0.5 or more that are found."""
    rnd = random.Random(5)
    sets = {}
    for base in range(40):
        pool = rnd.sample(range(100_000), 120)
        for v in range(6):
            sets[base * 10 + v] = set(pool[: 120 - 5 * v]) | set(rnd.sample(range(100_000), 6 * v))
    rows = spark.createDataFrame([(g, h) for g, x in sets.items() for h in x], "id long, hash long")
    near, member = U.lsh_nearest(rows, "id", 3)
    got = {(r.item, r.neighbor): r.value for r in near.collect()}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert member.count() == len(sets) and all(abs(v - jac(a, b)) < 1e-12 for (a, b), v in got.items())
    want = [(a, b) for a in sets for b in sorted((x for x in sets if x != a), key=lambda x: (-jac(a, x), x))[:3] if jac(a, b) >= 0.5]
    assert len(want) > 300 and sum(p in got for p in want) >= 0.9 * len(want)


def test_register_parameters(spark):
    a, b = U.register_parameters(8.0, 2.0**-13, 16)
    rows = spark.createDataFrame([(8.0,), (2.0**-13,)], "x double").select(U.quantized(F.col("x"), a, b * (1 + 1e-12), 16).alias("q")).collect()
    assert [r.q for r in rows][0] == 0 and rows[1].q in (15, 16)


def test_samples_and_unions(spark):
    counts = spark.createDataFrame([("a", k, k % 5 + 1) for k in range(500)] + [("b", k, 1) for k in range(400, 700)], "g string, kmer long, n long")
    sample = U.bottom_k_sample(counts, "g", 50)
    assert {(r.g, r.hash) for r in sample.collect()} == {(r.g, r.hash) for r in U.bottom_k(counts, "g", 50).collect()}
    assert sample.filter("g = 'a' AND n <> kmer % 5 + 1").count() == 0
    whole = U.bottom_k(counts.select(F.lit("u").alias("g"), "kmer"), "g", 50)
    assert {r.hash for r in U.merged(sample, 50).collect()} == {r.hash for r in whole.collect()}


def test_screen_and_accept(spark):
    from strandloom.functions.specs import Seed

    refs = spark.createDataFrame([(1, "ACGTACG"), (2, "TTTTTTT")], "id long, seq string")
    index = A.inverted_index(refs, Seed(4))
    got = {(r.id, r.ref): r.hits for r in A.screen(spark.createDataFrame([(9, "ACGTAAAA")], "id long, seq string"), index, Seed(4)).collect()}
    assert got[(9, 1)] >= 2 and got[(9, 2)] == 1
    assert A.accepted(index, index.limit(1)).count() == 1


def test_candidates_are_scored_from_their_sequences(spark, monkeypatch):
    """As from their items, with what is written bounded by the sequences: k-mers, eight bytes a letter, are not."""
    from strandloom import storage
    from strandloom.functions.specs import Seed
    from strandloom.operators import kmers as K

    rnd = random.Random(9)
    base = ["".join(rnd.choices("ACGT", k=3000)) for _ in range(12)]
    rows = [(i * 10 + v, x[200 * v :] + "." + "".join(rnd.choices("ACGT", k=200 * v))) for i, x in enumerate(base) for v in range(5)]
    rows += [(500, base[0]), (501, ""), (502, None), (503, "ACGT"), (None, base[1][:900])]
    docs, seed = spark.createDataFrame(rows, "id long, seq string"), Seed(13)
    items = K.counted_each(docs, seed).select("id", F.col("kmer").alias("hash")).cache()
    tell = lambda near, member: (sorted(map(tuple, near.collect())), sorted(tuple(r) for r in member.collect() if r.id is not None))
    want = tell(*U.lsh_nearest(items, "id", 3))
    held = []
    for module in (U, K):
        monkeypatch.setattr(module, "written", lambda df, name, instead=None: held.append(df.columns) or storage.written(df, name, instead))
    assert tell(*U.lsh_nearest(items, "id", 3, score=lambda pairs: K.jaccards(pairs, docs, seed))) == want and len(want[0]) > 100
    assert not any(c in ("hash", "kmer") for x in held for c in x)


def test_scores_of_repeated_keys(spark):
    """Rows of one key are one set; pairs that share nothing have no row."""
    from strandloom.functions.specs import Seed
    from strandloom.operators import kmers as K

    docs = spark.createDataFrame([("a", "ACCCA"), ("a", "GATTA"), ("b", "GATTACC"), ("c", "CTCTC")], "id string, seq string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "i string, j string")
    sets = {k: {s[p : p + 4] for n, s in (("a", "ACCCA"), ("a", "GATTA"), ("b", "GATTACC"), ("c", "CTCTC")) if n == k for p in range(len(s) - 3)} for k in "abc"}
    got = [({r.i, r.j}, r.jaccard) for r in K.jaccards(pairs, docs, Seed(4, canonical=False)).collect()]
    assert got == [({"a", "b"}, len(sets["a"] & sets["b"]) / len(sets["a"] | sets["b"]))]


def test_the_query_writes_no_kmers(spark, tmp_path, monkeypatch):
    from strandloom import queries as Q
    from strandloom import storage
    from strandloom.operators import kmers as K

    held = []
    for module in (Q, U, K):
        monkeypatch.setattr(module, "written", lambda df, name, instead=None: held.append(df.columns) or storage.written(df, name, instead))
    text = "one text of some words that are long enough for a set of many"
    spark.createDataFrame([(1, text), (2, text + " more"), (3, text + " more")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["id"], r["class"], r.neighbor, r.place) for r in Q.lsh_neighbors(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2, 1), (2, 2, 1, 1), (3, 2, 1, 1)} and not any("hash" in x for x in held)
