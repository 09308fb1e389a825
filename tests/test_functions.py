"""Scalar functions, alphabets, seeds and hashes against fixed values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import hashes as H
from strandloom.functions import sequence as S
from strandloom.functions.specs import ALPHABETS, Seed, alphabet, parse_spacing, show_spacing


def test_mix_and_inverse():
    given_ = np.array([0, 1, 2, 137, 2**64 - 1], dtype=np.uint64)
    assert H.mix(given_).tolist() == [8633297058295171728, 6614235796240398542, 13228483051453548148, 2642537501211252942, 2272383144869939092]
    many = np.concatenate([np.arange(10000, dtype=np.uint64), np.random.default_rng(1).integers(0, 2**64, 10000, dtype=np.uint64), given_])
    assert (H.unmix(H.mix(many)) == many).all()


def test_lexical_score_is_injective():
    x = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(H.lexical_score(x))) == len(x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 40))
def test_rolling_hashes_are_those_of_each_window(codes, k):
    codes = np.array(codes)
    if len(codes) < k:
        return
    words, comp = H.table(5, 4), np.array([3, 2, 1, 0])
    whole = H.cyclic(codes, k, words)
    both = H.strand_free(codes, k, words, comp)
    poly = H.karp_rabin(codes, k)
    assert len(whole) == len(codes) - k + 1
    for i in range(len(whole)):
        one, p = 0, 0
        for c in codes[i : i + k].tolist():
            one = (((one << 1) | (one >> 63)) & (2**64 - 1)) ^ int(words[c])
            p = (p * 37 + c) % 2**64
        assert int(whole[i]) == one and int(poly[i]) == p
    other = H.strand_free(3 - codes[::-1], k, words, comp)
    assert (both == other[::-1]).all()


def test_spacing_round_trip():
    assert parse_spacing("1,2,0x28", 31) == (1, 2) + (0,) * 28
    assert Seed(31, gaps=parse_spacing("1,2,0x28", 31)).span == 34
    assert show_spacing((1, 2) + (0,) * 28) == "1,2,0x28"
    assert parse_spacing("", 4) == (0, 0, 0)
    with pytest.raises(ValueError):
        parse_spacing("1,2", 31)


def test_alphabets():
    for name in ALPHABETS:
        letters = "".join(alphabet(name).classes)
        assert len(letters) == len(set(letters)), name
        assert alphabet(name).lut()[ord(letters[0].lower())] == 0
    assert alphabet("PROTEIN").lut()[ord("U")] == alphabet("AMINO20").lut()[ord("C")]
    assert alphabet("DNA").lut()[ord("u")] == 3 and alphabet("DNA5").lut()[ord("N")] == 4
    assert (alphabet("DNA").most_k(64), alphabet("AMINO20").most_k(64), alphabet("SEB14").most_k(64), alphabet("SEB6").most_k(64), alphabet("BYTES").most_k(64)) == (32, 14, 16, 24, 8)


@pytest.mark.parametrize("seq,code,other,code_other,least", [("ACGT", 27, "ACGT", 27, 27), ("AAAA", 0, "TTTT", 255, 0), ("GATTACA", 9156, "TGTAATC", 15117, 9156), ("CCGTA", 364, "TACGG", 794, 364)])
def test_strands(spark, seq, code, other, code_other, least):
    s = F.lit(seq)
    row = spark.range(1).select(S.encode(s).alias("a"), S.revcomp(s).alias("b"), S.encode(S.revcomp(s)).alias("c"), S.encode(S.canonical(s)).alias("d"), S.decode(S.encode(s), len(seq)).alias("e")).first()
    assert tuple(row) == (code, other, code_other, least, seq)


def test_columns(spark):
    row = spark.range(1).select(
        S.revcomp(F.lit("ACGTACCTTATATATATA")).alias("rc"), F.round(S.entropy(F.lit("AAAC")), 12).alias("e"), S.entropy(F.lit("ACGT")).alias("e2"), S.entropy(F.lit("AAAA")).alias("e0"),
        S.encode(F.lit("ACNT")).alias("bad"), S.gc_count(F.lit("GATTACA")).alias("gc"), S.compare_bits(F.lit(7).cast("long"), F.lit(5).cast("long")).alias("p"),
        S.compare_bits(F.lit(5).cast("long"), F.lit(7).cast("long")).alias("q"), S.compare_bits(F.lit(6).cast("long"), F.lit(3).cast("long")).alias("r"), S.compare_sets(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))).alias("s"),
        S.decode_spaced(S.encode(F.lit("ACGT")), 4, (1, 2, 0)).alias("gap"), S.words_popcount(F.array(F.lit(7).cast("long"), F.lit(-1).cast("long"))).alias("pop"), S.bit_string(F.lit(5).cast("long"), 8).alias("bits"),
        S.rotate_left(F.lit(-(1 << 63)), 1).alias("rot"), S.compare_sets(F.array(F.lit(1)), F.array(F.lit(2), F.lit(1))).alias("t"),
    ).first()
    assert tuple(row) == ("TATATATATAAGGTACGT", round(0.8112781244591328, 12), 2.0, 0.0, None, 2, "FIRST_PARENT", "SECOND_PARENT", "INCOMPARABLE", "EQUAL", "A-C--GT", 67, "00000101", 1, "SECOND_PARENT")
