"""Trees, databases, classification and new taxa on small hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.specs import Seed
from strandloom.operators import classify as C
from strandloom.operators import database as D
from strandloom.operators import metatree as M
from strandloom.operators import taxonomy as T

PARENT = {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4, 7: 3}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(list(PARENT.items()), "taxid int, parent int")


@pytest.fixture(scope="module")
def at(tree):
    return T.nodes(tree)


def path(x):
    out = [x]
    while PARENT[out[-1]]:
        out.append(PARENT[out[-1]])
    return out[::-1]


def lca(xs):
    xs = [x for x in xs if x]
    if not xs:
        return 0
    return max(set.intersection(*[set(path(x)) for x in xs]), key=lambda n: len(path(n)))


def test_closure_and_depth(spark, tree, at):
    near = T.closure(tree)
    got = {(r.taxid, r.anc): r.dist for r in near.collect()}
    assert got == {(x, a): len(path(x)) - len(path(a)) for x in PARENT for a in path(x)}
    assert {r.taxid: r.depth for r in at.collect()} == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 3}
    pairs = spark.createDataFrame([(6, 1), (6, 2), (6, 3)], "leaf int, root int")
    assert {(r.leaf, r.root): r.dist for r in T.distance(near, pairs, "leaf", "root").collect()} == {(6, 1): 3, (6, 2): 2, (6, 3): None}
    assert {r.parent: r.children for r in T.children(tree).collect()} == {1: [2, 3], 2: [4, 5], 3: [7], 4: [6]}
    some = spark.createDataFrame([(6,), (7,)], "taxid int")
    assert {r.taxid for r in T.used(near, some).collect()} == {1, 2, 3, 4, 6, 7}
    assert {r.taxid for r in T.under(near, some, spark.createDataFrame([(2,)], "taxid int")).collect()} == {6}
    assert {(r.anc, r.taxid) for r in T.descendants(near).collect() if r.anc == 2} == {(2, 4), (2, 5), (2, 6)}


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        T.closure(spark.createDataFrame([(1, 0), (2, 3), (3, 2)], "taxid int, parent int"))


def test_deep_tree(spark):
    chain = spark.range(1, 101).select(F.col("id").alias("taxid"), (F.col("id") - 1).alias("parent"))
    assert T.closure(chain).count() == 100 * 101 // 2


def test_lca(spark, at):
    cases = [(4, 5, 2), (6, 5, 2), (6, 7, 1), (6, 4, 4), (0, 5, 5), (1, 7, 1), (9, 9, 9), (9, 4, None)]
    pairs = spark.createDataFrame([(a, b) for a, b, _ in cases], "a int, b int")
    assert {(r.a, r.b): r.lca for r in T.lca_pairs(pairs, at, "a", "b").collect()} == {(a, b): c for a, b, c in cases}


def test_lca_of_sets(spark, at):
    rnd = random.Random(2)
    sets = {i: [rnd.choice([0, *PARENT]) for _ in range(rnd.randrange(1, 5))] for i in range(60)}
    sets[99] = [4, 77]
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "k int, taxid int")
    got = {r.k: r.lca for r in T.lca_by(rows, ["k"], at).collect()}
    assert got.pop(99) is None
    assert got == {k: lca(v) for k, v in sets.items() if k != 99}


def test_ranks(spark, tree):
    ranked = tree.join(spark.createDataFrame([(4, "genus"), (5, "genus"), (6, "species"), (2, "family")], "taxid int, rank string"), "taxid", "left")
    assert [r.taxid for r in T.sorted_taxa(ranked).collect()] == [6, 4, 5, 2, 1, 3, 7]
    with pytest.raises(Exception, match="unknown rank"):
        tree.select(T.level(F.lit("clan"))).collect()
    assert len(T.RANKS) == 31 and T.RANKS.index("species") == 27


def test_reform(spark, tree):
    genomes = spark.createDataFrame([("a", 6), ("b", 6), ("c", 7)], "genome string, taxid int")
    new_tree, own, ids = T.reform(tree, genomes)
    old = {r.new: r.old for r in ids.collect()}
    assert {r.genome: old[r.taxid] for r in own.collect()} == {"a": 8, "b": 9, "c": 7}
    assert {old[r.taxid]: old.get(r.parent, 0) for r in new_tree.collect()} == {**PARENT, 8: 6, 9: 6}
    assert sorted(old) == list(range(1, 10))


HITS = [({}, 0), ({6: 3}, 6), ({6: 2, 5: 2}, 2), ({6: 1, 4: 1, 5: 2}, 2), ({7: 5, 6: 2, 2: 4}, 6), ({6: 1, 7: 1}, 1), ({4: 3, 6: 1, 5: 3}, 6)]


def test_resolve(spark):
    rows = [(i, [(t, n, path(t)) for t, n in h.items()]) for i, (h, _) in enumerate(HITS)]
    df = spark.createDataFrame(rows, "i int, hits array<struct<taxid:int,n:long,path:array<int>>>")
    assert {r.i: r.taxon for r in df.select("i", C.resolve(F.col("hits")).alias("taxon")).collect()} == {i: want for i, (_, want) in enumerate(HITS)}


@pytest.fixture(scope="module")
def genomes(spark):
    rnd = random.Random(4)
    part = {t: "".join(rnd.choices("ACGT", k=200)) for t in PARENT}
    seqs = [(f"g{t}", t, "N".join(part[x] for x in path(t))) for t in (5, 6, 7)]
    return spark.createDataFrame(seqs, "genome string, taxid int, seq string"), part


def test_build_classify_render(spark, tree, at, genomes, tmp_path):
    df, part = genomes
    seed = Seed(15)
    db = D.lca_map(df, seed, at)
    assert {r.taxid: r.n for r in D.histogram(db).collect()} == {1: 186, 2: 186, 5: 186, 6: 372, 7: 372}
    D.save(db, Seed(15, 20, (), True), str(tmp_path / "db"), buckets=2)
    back, s = D.load(spark, str(tmp_path / "db"))
    assert back.count() == db.count() and s == Seed(15, 20)
    assert {r.taxid: r.d for r in D.depth_map(db, at).groupBy("taxid").agg(F.max("depth").alias("d")).collect()} == {1: 1, 2: 2, 5: 3, 6: 4, 7: 3}
    assert {r.taxid: r.g for r in D.feature_map(df, seed, at).groupBy("taxid").agg(F.max("n_genomes").alias("g")).collect()} == {1: 3, 2: 2, 5: 1, 6: 1, 7: 1}
    reads = spark.createDataFrame([(1, part[6][:50]), (2, part[2][:30] + "N" + part[5][:20]), (3, "T" * 40), (4, ""), (5, None), (6, "ACG")], "id int, seq string")
    got = {r.id: (r.taxon, r.len, r.hits, r.missing, r.ambig) for r in C.classify(reads, db, at, seed).collect()}
    assert got == {1: (6, 50, 36, 0, 0), 2: (5, 51, 22, 0, 15), 3: (0, 40, 0, 26, 0), 4: (0, 0, 0, 0, 0), 5: (0, 0, 0, 0, 0), 6: (0, 3, 0, 0, 0)}
    runs = {r.id: r.runs for r in C.taxa_runs(reads, db, seed).collect()}
    assert runs[1] == "6:36" and runs[2] == "2:16\t5:6" and runs[3] == "0:0"
    assert {r.id: r.runs for r in C.taxa_runs(reads, db, seed, full=True).collect()}[2] == "2:16\tA:15\t5:6"
    lines = {r.value for r in C.kraken_lines(C.classify(reads, db, at, seed), C.taxa_runs(reads, db, seed)).collect()}
    assert "C\t1\t6\t50\t6:36" in lines and "U\t3\t0\t40\tM:26\t0:0" in lines
    assert C.kraken_lines(C.classify(reads, db, at, seed), C.taxa_runs(reads, db, seed), everything=False).count() == 2
    fq = {r.id: r.value for r in C.fastq_records(reads, C.classify(reads, db, at, seed)).collect()}
    assert fq[1] == f"@1 C\t6\t50\n{part[6][:50]}\n+\n{part[6][:50]}"
    mates = reads.filter("id < 3").withColumn("mate", F.col("id")).withColumn("id", F.lit(1))
    assert C.taxa_runs(mates, db, seed, mate="mate").first().runs == "6:36\t2:16\t5:6"
    repeated = df.unionByName(df.withColumn("seq", F.substring("seq", 1, 100)))  # genomes of several rows
    assert {r.taxid: r.g for r in D.feature_map(repeated, seed, at).groupBy("taxid").agg(F.max("n_genomes").alias("g")).collect()} == {1: 3, 2: 2, 5: 1, 6: 1, 7: 1}
    assert [(r.taxon, r.hits, r.ambig) for r in C.classify(mates, db, at, seed).collect()] == [(6, 58, 15)]
    assert {r.classified: r.n for r in C.summary(C.classify(reads, db, at, seed)).collect()} == {True: 2, False: 4}


@pytest.mark.parametrize("mode", D.MODES)
def test_modes_build_subsets(at, genomes, mode):
    df, _ = genomes
    whole = {(r.kmer, r.taxid) for r in D.lca_map(df, Seed(15), at).collect()}
    some = {(r.kmer, r.taxid) for r in D.build(df, Seed(15, 30), at, mode).collect()}
    assert some and some < whole


def test_patterns(spark, tree):
    sets = spark.createDataFrame([(g, k) for k, gs in {1: "ab", 2: "ab", 3: "abc", 4: "a", 5: "abcd", 6: "bc"}.items() for g in gs], "g string, kmer int")
    counts = M.group_patterns(sets, "g")
    assert {tuple(r.pattern): r.n for r in counts.collect()} == {("a", "b"): 2, ("a", "b", "c"): 1, ("b", "c"): 1}
    assert {(tuple(r.upper), tuple(r.lower)) for r in M.containment(counts).collect()} == {(("a", "b", "c"), ("a", "b")), (("a", "b", "c"), ("b", "c"))}
    assert {tuple(r.pattern): r.score for r in M.addition_scores(counts, 4).collect()} == {("a", "b"): -1, ("b", "c"): -1, ("a", "b", "c"): 1 + 4 + 2}
    sub = M.subtree_patterns(spark.createDataFrame([(4, 1), (5, 1), (4, 2), (2, 1), (2, 3), (3, 1)], "taxid int, kmer int"), tree, T.closure(tree))
    assert sub.count() == 0  # patterns of one or all clades say nothing
    wide = spark.createDataFrame([(1, 0)] + [(x, 1) for x in (2, 3, 4)], "taxid int, parent int")
    sub = M.subtree_patterns(spark.createDataFrame([(2, 1), (3, 1), (2, 2), (3, 2), (3, 3), (4, 3), (2, 4), (3, 4), (4, 4)], "taxid int, kmer int"), wide, T.closure(wide))
    scored = M.node_scores(sub)
    assert {tuple(r.pattern): (r.n, r.score) for r in scored.collect()} == {(2, 3): (2, 2), (3, 4): (1, 1)}
    assert [tuple(r) for r in M.emit(scored, 4, 5).collect()] == [(5, 2, 1, "2,3"), (6, 1, 1, "3,4")]
    assert [r["pattern"] for r in M.condense(sub, 10)] == [(2, 3), (3, 4)]
    assert (M.room(7), M.room(8), M.room(9)) == (1, 0, 7)
