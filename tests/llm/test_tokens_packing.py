"""Token counts and packing against the library itself and against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import packing as P
from strandloom.llm import token_counts as T
from strandloom.llm import vocab as V
from strandloom.llm.common import written

from .conftest import ODD

CHARS = st.lists(st.one_of(st.sampled_from([*"abcXYZ'stréÿßİΣς .,!#0129\n\t\x0b\u0085 é́<|>", "<|endoftext|>", "'re"]), st.characters(codec="utf-8")), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(CHARS, min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    want = V.encode(path, texts)
    for piece in (8, 1 << 18):
        assert [np.frombuffer(x, "<u4").tolist() for x in V.fold_texts(texts, path, "ids", piece)] == want
    assert T.lengths(texts, path) == [len(x) for x in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["Hello  world\n", "", None, "é 漢"]
    assert T.lengths(texts, path) == [len(x) for x in V.encode(path, [t or "" for t in texts])]


def test_memory_of_units_is_bounded(words_path, monkeypatch):
    monkeypatch.setattr(V, "REMEMBER", 50)
    memo = V.Memo(words_path, "length", False)
    for i in range(40):
        lists = [[f"w{i}x{j}" for j in range(9)] + ["the"]]
        assert memo.fold(lists) == [sum(len(V.encode(words_path, [w])[0]) for w in lists[0])]
        assert len(memo.known) <= 50 + 10 and len(memo.known.old) <= 50 + 10


def test_counts_of_odd_rows(odd, clash, none, words_path):
    got = sorted(map(str, T.token_counts(odd, words_path).collect()))
    want = [(i, len((t or "").encode()), len(V.encode(words_path, [t or ""])[0])) for i, t, *_ in ODD]
    assert len(got) == len(ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in T.token_counts(odd, words_path).collect()) == Counter(want)
    assert sorted(map(str, T.token_counts(clash, words_path).collect())) == got
    assert T.token_counts(none, words_path).count() == 0


def check_plan(counts, capacity):
    """Bins as lists of (offset, length), from the runs."""
    bins, ranks = {}, Counter()
    for length, first, n, each, base, offset in sorted(P.plan(counts, capacity)):
        assert first == ranks[length]
        ranks[length] += n * each
        for j in range(n * each):
            bins.setdefault(base + j // each, []).append((offset + j % each * length, length))
    assert ranks == Counter({k: v for k, v in counts.items() if v})
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 9), max_size=20))
def test_plan_places_everything_once(counts):
    check_plan(counts, 40)


def test_plan_is_tight():
    rnd = random.Random(5)
    counts = Counter(min(4096, int(rnd.lognormvariate(6.5, 1.1)) + 1) for _ in range(20000))
    bins = check_plan(counts, 4096)
    assert len(bins) <= 1.01 * sum(k * v for k, v in counts.items()) / 4096 + 1
    assert len(check_plan({1366: 4}, 4096)) == 2  # over a third: two fit
    assert len(check_plan({4096: 3, 2048: 2}, 4096)) == 4


def test_pack_round_trip(table, words_path, spark):
    rows = [(i, "lorem ipsum dolor " * (i % 37) + f"end {i}", "en", "s") for i in range(150)] + [(900, "word " * 9000, "en", "s"), (901, None), (902, ""), (None, "null id")]
    docs = table(rows)
    out = P.pack(written(P.pieces(docs, words_path, with_ids=True), "p")).collect()
    by = {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 4096
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 4096 for p in parts[:-1])
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == V.encode(words_path, [text or ""])[0] + [1]
        assert [p.start for p in parts] == [4096 * k for k in range(len(parts))]
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
    assert len(bins) <= sum(r.length for r in out) / 4096 + 2


def test_pack_odd_rows(odd, clash, none, words_path):
    for docs in (odd, clash):
        out = P.pack(written(P.pieces(docs, words_path), "p")).collect()
        assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, *_ in ODD)
        assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert P.pack(written(P.pieces(none, words_path), "p")).count() == 0
