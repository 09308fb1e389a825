"""K-mers and minimizers against plain loops, and the counts that the seeds imply."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions.specs import Seed, alphabet
from strandloom.operators import kmers as K
from strandloom.operators import sets as A


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def number(s):
    out = 0
    for c in s:
        out = out * 4 + "ACGT".index(c)
    return out


def plain(seq, seed):
    """(place, k-mer string) of all clean seeds."""
    out = []
    for i in range(len(seq) - seed.span + 1):
        s = "".join(seq[i + o] for o in seed.offsets()).upper()
        if set(s) <= set("ACGT"):
            out.append((i, s if seed.stranded else min(s, revcomp(s))))
    return out


def windows(seq, seed, across=False):
    found, m, out = plain(seq, seed), seed.window, []
    for j in range(len(found) - m + 1):
        part = found[j : j + m]
        if across or part[-1][0] - part[0][0] == m - 1:
            out.append(min(part, key=lambda x: (x[1], x[0])))
    return out


DNA = st.text(alphabet="ACGTacgtN.", max_size=120)
SEEDS = [Seed(3), Seed(5, canonical=False), Seed(7), Seed(4, 9), Seed(4, 9, canonical=False), Seed(4, 0, (1, 0, 2)), Seed(3, 12, (1, 1))]


@settings(max_examples=80, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DNA, min_size=1, max_size=5), st.sampled_from(SEEDS))
def test_kernel_against_loops(seqs, seed):
    lut = alphabet("DNA4").lut()
    got = []
    for first, codes, owner, begin in K.joined(seqs, lut):
        at, value = K.seeds_of(codes, owner, seed)
        at, value = K.minimizers_of(at, value, owner, seed, "raw", False)
        got += [(int(owner[a]) + first, int(a - begin[owner[a]]), int(v)) for a, v in zip(at, value)]
    want = [(i, p, number(s)) for i, seq in enumerate(seqs) for p, s in windows(seq, seed)]
    assert got == want


@settings(max_examples=40, deadline=None)
@given(DNA, st.sampled_from([Seed(4, 9), Seed(4, 7, canonical=False)]))
def test_windows_across_gaps(seq, seed):
    lut = alphabet("DNA4").lut()
    got = []
    for _, codes, owner, _ in K.joined([seq], lut):
        at, value = K.minimizers_of(*K.seeds_of(codes, owner, seed), owner, seed, "raw", True)
        got += list(zip(at.tolist(), value.tolist()))
    assert got == [(p, number(s)) for p, s in windows(seq, seed, across=True)]


def random_dna(n, seed=3):
    import random

    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.mark.parametrize("w", [32, 55, 100, 300])
def test_number_of_minimizers(spark, w):
    seed = Seed(31, w, (1, 2, 18) + (0,) * 27)
    assert seed.span == 52
    df = spark.createDataFrame([(1, random_dna(5386))], "id int, seq string")
    assert K.kmers(df, seed).count() == 5386 - max(w, 52) + 1


def test_short_sequences(spark):
    df = spark.createDataFrame([(1, "ACGTACGTACGTACGTACGT"), (2, random_dna(52)), (3, ""), (4, None), (5, "NNNN")], "id int, seq string")
    rows = K.kmers(df, Seed(31, 0, (1, 2, 18) + (0,) * 27)).groupBy("id").count().collect()
    assert [tuple(r) for r in rows] == [(2, 1)]


def test_counts_fold_and_keys_stay(spark):
    rows = [(1, "x", "ACGTACGT"), (2, "x", "ACGTN"), (3, None, "TTTTT"), (4, None, "AAAAA")]
    df = spark.createDataFrame(rows, "id int, g string, seq string")
    got = {(r.g, r.kmer): r.n for r in K.counted(df, Seed(4), ["g"]).collect()}
    want = Counter((g, number(s)) for _, g, seq in rows for _, s in plain(seq, Seed(4)))
    assert got == dict(want)
    assert A.cardinality(df, Seed(4)).first().n == len({k for _, k in want})


def test_counts_of_each_row(spark):
    rows = [(1, "ACGTACGTAC"), (2, "ACGT"), (3, None), (4, "")]
    for more in ([], [(2, "ACGTT")], [(None, "AAAA"), (None, "AAAA")]):
        df = spark.createDataFrame(rows + more, "id long, seq string")
        one, two = (Counter(map(tuple, x.collect())) for x in (K.counted_each(df, Seed(4)), K.counted(df, Seed(4), ["id"])))
        assert one == two


def test_spans_of_numbers(spark):
    df = spark.createDataFrame([(5, "ACGTACGT"), (2, "ACGTT"), (9, "ACGT"), (None, "AAAA"), (1, None)], "n long, seq string")
    got = {r.kmer: (r.lo, r.hi) for r in K.spans(df, Seed(4, canonical=False), "n").collect()}
    assert got[number("ACGT")] == (2, 9) and got[number("CGTA")] == (5, 5) and number("AAAA") not in got and len(got) == 5


def test_entropy_minimizers_prefer_entropy(spark):
    df = spark.createDataFrame([(1, "AAAAAAACGTAAAAAAA")], "id int, seq string")
    best = {r.kmer for r in K.kmers(df, Seed(4, 10, canonical=False), score="entropy").collect()}
    assert number("ACGT") in best


def test_alphabets_and_long_windows(spark):
    df = spark.createDataFrame([(1, random_dna(500))], "id int, seq string")
    for name, k in (("AMINO20", 5), ("SEB8", 9), ("SEB14", 6), ("SEB6", 10), ("DNA2KETAMINE", 20), ("DNA2METHYL", 20), ("BYTES", 7)):
        assert K.kmers(df, Seed(k, canonical=False, alphabet=name)).count() == 500 - k + 1, name
    assert K.rolling(df, 100, 200).count() == 500 - 200 + 1
    same = K.rolling(df, 40).select("hash"), K.rolling(df.withColumn("seq", F.reverse(F.translate("seq", "ACGT", "TGCA"))), 40).select("hash")
    assert sorted(r.hash for r in same[0].collect()) == sorted(r.hash for r in same[1].collect())
    with pytest.raises(ValueError):
        Seed(40)


def test_multi_k_saturates(spark):
    df = spark.createDataFrame([("A" * 50,)], "seq string")
    got = {r.k: r.n for r in K.multi_k(df, [3, 5], saturate=47).collect()}
    assert got == {3: 47, 5: 46}


def test_score_minimizers_look_scores_up(spark):
    seq = random_dna(300, 9)
    df = spark.createDataFrame([(1, seq)], "id int, seq string")
    found = plain(seq, Seed(6))
    scores = {s: (number(s) * 7919) % 101 for _, s in found}
    table = spark.createDataFrame([(number(s), v) for s, v in scores.items()], "kmer long, score long")
    got = {r.kmer for r in K.score_minimizers(df, Seed(6, 15), table).collect()}
    want = {number(min(found[j : j + 10], key=lambda x: (scores[x[1]], number(x[1])))[1]) for j in range(len(found) - 9)}
    assert got == want
    with pytest.raises(Exception, match="no score"):
        K.score_minimizers(df, Seed(6, 15), table.limit(3)).collect()


def test_postings_index_and_chunks(spark):
    df = spark.createDataFrame([(1, "ACGTA"), (2, "TACGT")], "id long, seq string")
    got = {r.kmer: r.positions for r in A.postings(df, Seed(4, canonical=False)).collect()}
    assert got == {number("ACGT"): [3, 9], number("CGTA"): [4], number("TACG"): [8]}
    assert {r.kmer: r.ids for r in A.inverted_index(df, Seed(4, canonical=False)).collect()}[number("ACGT")] == [1, 2]
    assert {(r.id, r.chunk): r.n for r in A.chunk_cardinality(df, Seed(2, canonical=False), 2).collect()} == {(1, 0): 2, (1, 1): 2, (2, 0): 2, (2, 1): 2}
    assert {r.id: r.s for r in A.prefix_sums(df.withColumn("n", F.length("seq")), "id", "n", "s", 2).collect()} == {1: 0, 2: 5}


def test_short_sequences_give_their_least(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=rnd.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, seq string")
    k, m = 4, 12
    got = {}
    for r in K.kmers(df, Seed(k, k + m - 1, canonical=False), across_gaps=True, partial=True).collect():
        got.setdefault(r.id, []).append((r.pos, r.kmer))
    for i, s in rows:
        seeds = [(p, sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(s[p : p + k]))) for p in range(len(s) - k + 1) if "N" not in s[p : p + k]]
        wins = [seeds[j : j + m] for j in range(len(seeds) - m + 1)] or ([seeds] if seeds else [])
        want = [min(w, key=lambda x: (x[1], x[0])) for w in wins]
        assert sorted(got.get(i, [])) == sorted(want), s


def test_rolling_hashes_of_several_k(spark):
    rows = [(1, "ACGTNACGTACGTTGCA"), (2, ""), (3, None), (4, "ACG")]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {(r.id, r.k, r.pos): r.hash for r in K.rolling_set(df, [3, 5], family="karp_rabin").collect()}
    want = {}
    for i, s in rows:
        for k in (3, 5):
            for p in range(len(s or "") - k + 1):
                if "N" not in s[p : p + k]:
                    h = 0
                    for c in s[p : p + k]:
                        h = (h * 37 + "ACGT".index(c)) % 2**64
                    want[i, k, p] = h
    assert got == want
    one = {(r.id, r.pos): r.hash for r in K.rolling(df, 3, 6, family="karp_rabin", partial=True).collect()}
    assert one[4, 0] == want[4, 3, 0] and all(one[i, p] == want[i, 3, p] for i, p in one)


def test_entropy_of_the_last_letters(spark):
    import math

    s = "AACGTNACCCGTA"
    got = [(r.pos, r.value) for r in K.window_entropy(spark.createDataFrame([(1, s)], "id long, seq string"), 4).orderBy("pos").collect()]
    held, want = [], []
    for i, c in enumerate(s):
        if c == "N":
            held = []
            continue
        held = (held + [c])[-4:]
        p = [held.count(x) / 4 for x in set(held)]
        want.append((i, -1.0 if len(held) < 4 else sum(x * math.log(x) for x in p)))
    assert [p for p, _ in got] == [p for p, _ in want] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want))


def test_functions_of_the_callers_own(spark):
    df = spark.createDataFrame([(1, "ACGTACGGT"), (2, "TTT")], "id long, seq string")

    def even(row, pos, kmer):
        keep = kmer % 2 == 0
        return {"row": row[keep], "pos": pos[keep], "half": kmer[keep] // 2}

    seed = Seed(3, canonical=False)
    got = sorted(tuple(r) for r in K.for_each(df, seed, even, "pos long, half long").collect())
    assert got == sorted((r.id, r.pos, r.kmer // 2) for r in K.kmers(df, seed).collect() if r.kmer % 2 == 0)
    least = {(r.id, r.pos) for r in K.kmers(df, Seed(3, 5, canonical=False), score=lambda x, k: -x).collect()}
    most = {(r.id, r.pos) for r in K.kmers(df, Seed(3, 5, canonical=False)).collect()}
    assert least and least != most


def test_sums_of_rolling_hashes_move_no_hashes(spark):
    rows = [(1, "ACGTACGTNACGTTT"), (2, "AC"), (None, "GGGGGGGG"), (3, "TTACGATT"), (4, None)]

    def expected(rows):
        df = spark.createDataFrame(rows, "id long, seq string")
        out = {}
        for r in K.rolling_set(df, [3, 5], family="karp_rabin").collect():
            out.setdefault((r.id, r.k), []).append(r.hash % (1 << 64))
        return df, {x: (len(h), len(set(h)), sum(v % 1_000_003 for v in h)) for x, h in out.items()}

    got = lambda df: {(r.id, r.k): (r.hashes, r.kinds, r.residues) for r in K.rolling_sums(df, [3, 5], family="karp_rabin").collect()}
    df, want = expected(rows)
    assert got(df) == want and (None, 3) in want
    assert "Exchange" not in K.rolling_sums(df, [3, 5], family="karp_rabin")._jdf.queryExecution().executedPlan().toString()
    df, want = expected([*rows, (3, "ACGATTA"), (None, "GGGGC")])  # repeated keys
    assert got(df) == want
