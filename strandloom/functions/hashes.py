"""64-bit hashes of k-mers and rolling hashes of sequences, vectorised; arithmetic wraps modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit integer mix published by Thomas Wang: a bijection."""
    x = x.astype(U)
    x = ~x + (x << U(21))
    x = x ^ (x >> U(24))
    x = x * U(265)  # 1 + 2**3 + 2**8
    x = x ^ (x >> U(14))
    x = x * U(21)  # 1 + 2**2 + 2**4
    x = x ^ (x >> U(28))
    return x + (x << U(31))


def _unshift(x: np.ndarray, n: int) -> np.ndarray:
    """The inverse of x ^ (x >> n)."""
    while n < 64:
        x = x ^ (x >> U(n))
        n *= 2
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix(), from the inverses of its steps."""
    x = x.astype(U) * U(pow(1 + (1 << 31), -1, 1 << 64))
    x = _unshift(x, 28) * U(pow(21, -1, 1 << 64))
    x = _unshift(x, 14) * U(pow(265, -1, 1 << 64))
    x = _unshift(x, 24)
    return (x + U(1)) * U(pow((1 << 21) - 1, -1, 1 << 64))


# The constants of the lexical score, in the order they are applied.
SCORE_XOR, SCORE_MULTIPLIER, SCORE_ROTATION, SCORE_LAST_XOR = 0x533F8C2151B20F97, 0x9A98567ED20C127D, 31, 0x691A9D706391077A


def lexical_score(kmer: np.ndarray) -> np.ndarray:
    """A bijective score that breaks the order of k-mers, so minimizers are not all runs of A."""
    x = (kmer.astype(U) ^ U(SCORE_XOR)) * U(SCORE_MULTIPLIER)
    x = (x << U(SCORE_ROTATION)) | (x >> U(64 - SCORE_ROTATION))
    return x ^ U(SCORE_LAST_XOR)


def x31(data: bytes) -> int:
    """The string hash of base 31."""
    out = 0
    for c in data:
        out = (out * 31 + c) & _ALL
    return out


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if n == 0 else (x << U(n)) | (x >> U(64 - n))


def table(seed: int, size: int = 256) -> np.ndarray:
    """Random words for the letters, from a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, size=size, dtype=U)


def cyclic(codes: np.ndarray, k: int, words: np.ndarray) -> np.ndarray:
    """Buzhash of every window of k letters: the xor of their words, each rotated by its distance from the end.

    Windows double: a window of a + b letters is its first a, rotated by b, xor its last b.
    """
    return _double(words[codes], k, lambda head, tail, n: _rotate(head, n) ^ tail)


def cyclic_other_strand(codes: np.ndarray, k: int, words: np.ndarray, complement: np.ndarray) -> np.ndarray:
    """The same of the reverse complement of every window."""
    return _double(words[complement[codes]], k, lambda head, tail, n, m=None: head ^ _rotate(tail, m), back=True)


def strand_free(codes: np.ndarray, k: int, words: np.ndarray, complement: np.ndarray) -> np.ndarray:
    """A hash that both strands share: the lesser of the two."""
    return np.minimum(cyclic(codes, k, words), cyclic_other_strand(codes, k, words, complement))


def karp_rabin(codes: np.ndarray, k: int, base: int = 37) -> np.ndarray:
    """Polynomial hash of every window of k letters."""
    return _double(codes.astype(U), k, lambda head, tail, n: head * U(pow(base, n, 1 << 64)) + tail)


def _double(one: np.ndarray, k: int, join, back: bool = False) -> np.ndarray:
    """Values of all windows of k from those of windows of 1, in about 2 log2(k) vector steps.

    join(head, tail, length of tail[, length of head]) is the value of a window from its two parts.
    """
    result, have, power, size = None, 0, one, 1
    while k:
        if k & 1:
            if result is None:
                result, have = power, size
            else:
                n = len(power) - have
                head, tail = result[: max(0, min(len(result), n))], power[have:][: max(0, min(len(result), n))]
                result = join(head, tail, size, have) if back else join(head, tail, size)
                have += size
        k >>= 1
        if k:
            n = max(0, len(power) - size)
            power = join(power[:n], power[size:], size, size) if back else join(power[:n], power[size:], size)
            size *= 2
    return result
