"""Scalar functions on sequences and k-mers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .specs import alphabet

# The DNA view of a text gives the letters a to z these bases in turn.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def as_dna(text: Column) -> Column:
    """A text as DNA: letters by BASES, a full stop as an ambiguous base, all else dropped."""
    return F.regexp_replace(F.translate(text, LETTERS + LETTERS.upper(), BASES * 2), "[^ACGT.]", "")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa")


def revcomp(seq: Column) -> Column:
    """The other strand; letters that are no bases stay."""
    return F.reverse(complement(seq))


def canonical(seq: Column) -> Column:
    """The lesser strand of a k-mer; letters sort as their codes do."""
    return F.least(seq, revcomp(seq))


def encode(seq: Column) -> Column:
    """A k-mer of at most 31 bases as a number, first base most significant; null if a letter is no base."""
    up = F.upper(seq)
    return F.when(up.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(up, "ACGT", "0123"), 4, 10).cast("long"))


def decode(kmer: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def decode_spaced(kmer: Column, k: int, gaps: tuple[int, ...]) -> Column:
    """A spaced k-mer with a dash for each skipped base."""
    plain = decode(kmer, k)
    parts = [F.substring(plain, 1, 1)]
    for i, g in enumerate(gaps):
        parts.append(F.concat(F.lit("-" * g), F.substring(plain, i + 2, 1)))
    return F.concat(*parts)


def base_count(seq: Column, bases: str) -> Column:
    """How many letters of seq are one of bases."""
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def gc_count(seq: Column) -> Column:
    return base_count(seq, "GCgc")


def entropy(seq: Column) -> Column:
    """Shannon entropy of the bases in bits; a base that is missing adds nothing."""
    n = base_count(seq, "ACGT")
    total = F.lit(0.0)
    for b in "ACGT":
        p = base_count(seq, b) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(n > 0, total)


def reduce_alphabet(seq: Column, name: str) -> Column:
    """Each letter as the first of its class; all else dropped."""
    one = alphabet(name)
    source, target = one.letters()
    return F.regexp_replace(F.translate(seq, source + source.lower(), target * 2), f"[^{''.join(sorted({c[0] for c in one.classes}))}]", "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def words_popcount(words: Column) -> Column:
    """Set bits of an array of longs."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def bit_string(word: Column, bits: int = 64) -> Column:
    return F.lpad(F.bin(word), bits, "0")


def rotate_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def compare_sets(a: Column, b: Column) -> Column:
    """EQUAL, FIRST_PARENT (a holds b), SECOND_PARENT or INCOMPARABLE, of two arrays of distinct values."""
    over, under = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.when(over & under, "EQUAL").when(under, "FIRST_PARENT").when(over, "SECOND_PARENT").otherwise("INCOMPARABLE")


def compare_bits(a: Column, b: Column) -> Column:
    """The same of two words as bit sets."""
    over, under = a.bitwiseAND(F.bitwise_not(b)) == 0, b.bitwiseAND(F.bitwise_not(a)) == 0
    return F.when(over & under, "EQUAL").when(under, "FIRST_PARENT").when(over, "SECOND_PARENT").otherwise("INCOMPARABLE")
