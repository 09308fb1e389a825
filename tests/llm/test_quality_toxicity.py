"""Toxicity, fertility and perplexity against brute force, and on labelled rows that were held out."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import fertility as Q
from strandloom.llm import perplexity as P
from strandloom.llm import toxicity as T
from strandloom.llm import vocab as V
from strandloom.llm.common import written

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def brute_segments(scores):
    """All maximal segments: the best one, then those left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute_segments(scores[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-50, -50, -200, 100, 250, 425]), max_size=18))
def test_segments(scores):
    got = T.segments(np.array(scores, np.int64))
    assert got == brute_segments(scores)


@pytest.mark.parametrize("unit", [[300, *[-5] * 49], [300, -100], [100, -101], [100, -99], [300, -25, -200, 50, -300, 10]])
def test_segments_take_linear_time(unit):
    scores = np.tile(unit, 100_000)
    began = time.perf_counter()
    T.segments(scores)
    assert time.perf_counter() - began < 1.5 * len([x for x in unit if x > 0])


def test_lambda_and_k_solve_their_equations():
    lam = T.solve_lambda({4.0: 0.01, 2.0: 0.02, -0.25: 0.97})
    assert 0.01 * math.exp(4 * lam) + 0.02 * math.exp(2 * lam) + 0.97 * math.exp(-0.25 * lam) == pytest.approx(1, abs=1e-6)
    rng = np.random.default_rng(1)
    best = Counter((n, float(np.log(0.05 * n / e) / 1.5)) for n, e in zip(rng.integers(50, 900, 4000).tolist(), rng.exponential(size=4000)))
    assert T.fit_k(best, 1.5) == pytest.approx(0.05, rel=0.05)


def test_counts_and_scores_by_their_definition(spark, table):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(5, 30)) + ["vile"] * (i % 4 == 0) + ["nice"] * (i % 3 == 0))) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sample = T.fit_sample(table(rows), labels)
    texts = [(r.text, r.toxic) for r in sample.collect()]
    n = [Counter(w for t, toxic in texts if toxic == x for w in set(T.tokens(t))) for x in (False, True)]
    counts = T.word_counts(sample).groupBy("word").agg({"y0": "sum", "y1": "sum"}).toDF("word", "y0", "y1")
    assert {r.word: (r.y0, r.y1) for r in counts.collect()} == {w: (n[0][w], n[1][w]) for w in n[0] | n[1]}
    all_ = [sum(c.values()) for c in n]
    want = {}
    for w in n[0] | n[1]:
        a, b = (n[i][w] + 0.5 + 0.02 * (n[0][w] + n[1][w]) for i in (1, 0))
        whole = 0.5 * len(n[0] | n[1]) + 0.02 * sum(all_)
        ratio = math.log(a / (all_[1] + whole - a)) - math.log(b / (all_[0] + whole - b))
        score = round(100 * (math.copysign(max(0.0, abs(ratio) - 3 * math.sqrt(1 / a + 1 / b)), ratio) - 0.25))
        if score != -25:
            want[w] = score
    assert T.scores_of(counts) == want and want["vile"] > 0


def test_toxicity_does_not_depend_on_the_partitions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    out = []
    for parts in (1, 7, 32):
        docs.repartition(parts).write.parquet(str(tmp_path / str(parts)))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        dealt = spark.read.parquet(str(tmp_path / str(parts)))
        model = T.fit(dealt, labels)
        out.append((model, {r.doc_id: (r.score, r.n_passages) for r in T.score_texts(dealt, model).collect()}))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1] == out[2] and any(x > 0 for x in out[0][0].scores.values())


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in T.op1_toxic_segments(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(out[i].predicted, t) for i, t in labels.items() if out[i].held_out]
    assert sum(p and not t for p, t in held) <= 0.02 * sum(1 - t for _, t in held)
    assert sum(p and t for p, t in held) >= 0.6 * sum(t for _, t in held)


def test_toxicity_of_odd_rows(odd, clash, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for docs in (odd, clash):
        model = T.fit(docs, labels)
        out = T.score_texts(docs, model).collect()
        assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in ODD) and all(r.predicted in (0, 1) for r in out)
    empty = T.fit(odd, labels.limit(0))
    assert {r.score < 1e-6 for r in T.score_texts(odd, empty).collect()} == {True}
    assert T.score_texts(none, empty).count() == 0
    model = T.Model({"idiot": 600}, 1.0, 0.01, (-4.0, 2.0, 1.0))
    assert T.toxic_passages("x " * 50 + "idiot fool idiot " + "y " * 50, model)[0][:2] == (50, 52)


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + j for x in places.values() if len(x) > 1 for i in x for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a ", "b ", "c\n", "#x ", "\n", " \t\n", "é|", "a b c ", " "]), max_size=40))
def test_base_counts(parts):
    text = "".join(parts)
    words = V.WORDS.findall(text)
    assert (Q.repeated_words(words), Q.repeated_lines(text)) == (brute_base(text)[4], brute_base(text)[3])


def test_fertility_keeps_clean_and_rejects_junk(spark):
    out = {r.doc_id: r for r in Q.op2_token_fertility(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, text in docs.items():
        r, base = out[i], brute_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.kept and r.base_failed)
    judged = [(out[i].kept, q) for i, q in labels.items() if not out[i].base_failed]
    assert sum(k for k, q in judged if q) >= 0.99 * sum(q for _, q in judged)
    assert sum(k for k, q in judged if not q) <= 0.7 * sum(1 - q for _, q in judged)


def test_measures_are_those_of_the_words(words_path):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = np.array([i for w in ["hello", "漢", "hello"] for i in V.encode(path, [w])[0]])
    chars, share, entropy = Q.token_measures(ids.astype("<u2"), 11, Q.byte_tokens(path))
    n = Counter(ids.tolist())
    assert chars == 11 / len(ids) and share == pytest.approx(sum("<0x" in V.loaded(path).id_to_piece(int(i)) for i in ids) / len(ids))
    assert entropy == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()) / math.log2(len(ids)))


def test_fertility_of_odd_rows(odd, clash, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    for docs in (odd, clash):
        out = Q.quality_rules(docs, path).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter((i, *brute_base(t)) for i, t, *_ in ODD)
        assert not any(r.kept for r in out)
    assert Q.quality_rules(none, path).count() == 0


class BruteModel:
    """Interpolated modified Kneser-Ney by its definition, over dicts."""

    def __init__(self, texts, order):
        counts = {order: Counter(g for t in texts for g in (P.padded(t, order)[i : i + order] for i in range(len(P.padded(t, order)) - order + 1)))}
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
            plain = Counter(p[i : i + k] for p in (P.padded(t, order) for t in texts) for i in range(order - k, len(p) - k + 1))
            counts[k] = Counter({g: plain[g] if g[0] == P.BEGIN else c for g, c in counts[k].items()})
        self.order, self.counts, self.d = order, counts, {}
        for k, c in counts.items():
            n = Counter(c.values())
            n1, n2, n3, n4 = n[1], n[2], n[3], n[4]
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            self.d[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
        self.contexts = {k: defaultdict(list) for k in counts}
        for k, c in counts.items():
            for g, n in c.items():
                self.contexts[k][g[:-1]].append(n)

    def cut(self, k, n):
        return self.d[k][min(n, 3) - 1]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        seen = self.contexts[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        n = self.counts[k].get(gram, 0)
        free = sum(self.cut(k, x) for x in seen)
        return ((n - self.cut(k, n) if n else 0) + free * self.p(gram[1:])) / sum(seen)


@pytest.mark.parametrize("order,hot,block", [(2, 0, 1 << 20), (4, 20, 50), (5, 10**6, 1 << 20), (5, 0, 50)])
def test_kneser_ney_against_its_definition(spark, table, monkeypatch, order, hot, block):
    rnd = random.Random(7)
    words = ["the", "cat", "sat", "Mat", "é", "on."]
    good = [" ".join(rnd.choices(words, k=rnd.randrange(1, 30))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, "zzz ### \U0001f600"), (101, ""), (102, "cat\x02sat\x03"), (103, None), (104, good[0])]
    docs = table(rows)
    monkeypatch.setattr(P, "BLOCK_CHARS", block)
    model, unseen = P.train(docs.filter("doc_id < 40").select("text"), order)
    brute = BruteModel(good, order)
    got = {r.doc_id: r for r in scored(docs, model, unseen, order, hot).collect()}
    (grams, *_), whole = P.hot_grams(model, unseen, order, hot)
    assert sum(len(g) == order for g in grams) <= hot and (len(whole) == order) == (hot > 10**5)
    for i, t in rows:
        pad = P.padded(t or "", order)
        logs = [math.log(brute.p(pad[j : j + order])) for j in range(len(pad) - order + 1)]
        if i in (101, 103):
            assert got[i].perplexity is None
        else:
            assert got[i].perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6), i
    seen = {r.gram: r.p for r in model.filter("p IS NOT NULL").collect()}
    total = sum(seen[g] for g in seen if len(g) == 1) + unseen
    assert total == pytest.approx(1)


def scored(docs, model, unseen, order, hot):
    return P.perplexities(P.located(P.Located(docs), "doc_id", "text", "lang"), model, unseen, order, hot)


def test_numbering_of_grams(monkeypatch):
    rnd = random.Random(1)
    texts = [P.padded("".join(rnd.choices("abcé漢 ", k=rnd.randrange(0, 50))), 4) for _ in range(30)]
    want = Counter(t[i : i + 4] for t in texts for i in range(len(t) - 3))
    for cells in (1 << 24, 4):
        monkeypatch.setattr(P, "CELLS", cells)
        grams, n = P.gram_counts(texts, 4)
        assert dict(zip(grams, n.tolist())) == dict(want)


def test_classifier_keeps_clean_and_rejects_junk(spark):
    out = {r.doc_id: r.kept for r in P.op3_kneser_ney(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = ([out[i] for i, q in labels.items() if q == x] for x in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_classifier_of_odd_rows(odd, clash, none, spark):
    trusted = spark.createDataFrame([(1,), (7,), (None,)], "doc_id long")
    for docs in (odd, clash):
        out = P.classify(docs, trusted).collect()
        assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in ODD)
        assert all(r.kept is False and r.perplexity is None for r in out if r.doc_id in (3, 4, 5))
        kept = P.keep_good(docs, trusted)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert P.classify(none, trusted).count() == 0
    plain = P.classify(odd, trusted.limit(0)).collect()
    assert {r.doc_id for r in plain if not r.kept} == {3, 4, 5, None} and all(r.perplexity is None for r in plain)


def test_junk_copies_do_not_move_the_limit(spark, tmp_path):
    """A rejected junk text copied to a third of English, as it stands and with a word of its own in each copy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    trusted = P.trusted_labels(spark, SF)
    rnd = random.Random(4)
    junk = "".join(rnd.choices("bcdfgqxz#% ", k=600))
    copies = len(docs) // 2
    extra = [(10**6 + i, junk, "en") for i in range(copies)], [(10**6 + i, f"{junk} {rnd.getrandbits(40):x}", "en") for i in range(copies)]
    for more in extra:
        path = str(tmp_path / f"docs-{more[1][1] == junk}")
        spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs] + more, "doc_id long, text string, lang string").repartition(3).write.parquet(path)
        out = {r.doc_id: r.kept for r in P.classify(spark.read.parquet(path), trusted).collect()}
        assert not any(out[i] for i, *_ in more)
        bad = [out[r.doc_id] for r in docs if labels.get(r.doc_id) == 0]
        good = [out[r.doc_id] for r in docs if labels.get(r.doc_id) == 1]
        assert sum(bad) <= 0.25 * len(bad) and sum(good) >= 0.99 * len(good)


@pytest.mark.parametrize("hot", [0, 10**6])
def test_left_out_scores(spark, table, hot):
    """A trusted text's n-grams that no other has count as never seen: by the definition, their lower order answers."""
    rows = [(1, "the cat sat on the mat"), (2, "the dog ran"), (3, "the dog ran off"), (4, "the cat")]
    docs = table(rows)
    model, unseen = P.train(docs.filter("doc_id < 3").select("text"), 3)
    brute = BruteModel([t for _, t in rows[:2]], 3)
    for r in scored(docs, model, unseen, 3, hot).collect():
        pad = P.padded(dict(rows)[r.doc_id], 3)
        grams = [pad[i : i + 3] for i in range(len(pad) - 2)]
        own = Counter(grams)
        logs = []
        for g in grams:
            p = brute.p(g)
            if brute.counts[3][g] == own[g]:
                seen = brute.contexts[3][g[:-1]]
                p = sum(brute.cut(3, x) for x in seen) / sum(seen) * brute.p(g[1:])
            logs.append(math.log(p))
        assert r.left_out == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6)
        assert r.left_out > r.perplexity or r.doc_id > 3
    same = table([(1, "the cat sat"), (2, "the cat sat")])
    model, unseen = P.train(same.select("text"), 3)
    for r in scored(same, model, unseen, 3, hot).collect():
        assert r.left_out == pytest.approx(r.perplexity)


def weighted_quantile(pairs, q):
    """As Spark's percentile with frequencies: each value stands so many times."""
    pairs = sorted(pairs)
    ends = np.cumsum([w for _, w in pairs])
    at = q * (ends[-1] - 1)
    low, high = (pairs[int(np.searchsorted(ends, f(at), side="right"))][0] for f in (math.floor, math.ceil))
    return low + (high - low) * (at - math.floor(at))


def test_kept_by_its_definition(spark):
    rnd = random.Random(12)
    rows = [(i, lang, f"k{i if i % 5 else i // 5 % 7}", rnd.randrange(20, 900), rnd.lognormvariate(1.2, 0.3), rnd.lognormvariate(1.4, 0.3)) for i in range(400) for lang in [rnd.choice(["a", "a", "b", None, ""])]]
    rows = [(*r[:3], *[x for x in rows if x[2] == r[2]][0][3:], 0, r[0]) for r in rows]  # rows of one text are equal
    rows.append((None, "a", "none", 5, None, None, 0, 999))
    trusted = {i for i, lang, *_ in rows if i is not None and lang == "a" and i % 3 == 0} | {7, 14}
    scores = spark.createDataFrame(rows, "doc_id long, lang string, text_key string, n_signs long, perplexity double, left_out double, at_file long, at_place long")
    got = {r.at_place: r.kept for r in P.judged(written(scores, "t"), spark.createDataFrame([(i,) for i in sorted(trusted)], "doc_id long")).collect()}
    for lang in {r[1] for r in rows}:
        texts = {}
        for i, x, key, n, p, left, *_ in rows:
            if x == lang and p is not None:
                t = texts.setdefault((key, n), [False, p, left])
                t[0] |= i in trusted
        logs = [(n, own, round(math.log(left if own else p), 4)) for (key, n), (own, p, left) in texts.items()]
        others = max(1, sum(not own for _, own, _ in logs))

        def weights(values):
            bins = Counter()
            for (n, own, _), v in zip(logs, values):
                bins[v, own] += 1
            return [(v, 10**6 * c if own else math.ceil(50 * 10**6 * c / others)) for (v, own), c in bins.items()]

        middle = weighted_quantile(weights([x for *_, x in logs]), 0.5)
        away = weights([round((x - middle) * math.sqrt(n), 3) for n, _, x in logs])
        low, high = (weighted_quantile(away, q) for q in (0.25, 0.75))
        limit = high + 6 * max(high - low, 0.5)
        for i, x, key, n, p, left, _, at in rows:
            if x == lang:
                assert got[at] == (p is not None and (math.log(p) - middle) * math.sqrt(n) <= limit)


def test_junk_copies_do_not_move_the_bands(spark, tmp_path):
    """A rejected junk text copied to over a third of the rows of English."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").collect()]
    rnd = random.Random(5)
    junk = " ".join("".join(rnd.choices("bcdfgqxz", k=12)) for _ in range(60))
    more = [(10**6 + i, junk, "en") for i in range(2 * len(docs) // 3)]
    out = []
    for i, rows in enumerate((docs, docs + more)):
        spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / str(i)))
        out.append({r.doc_id: r.kept for r in Q.quality_rules(spark.read.parquet(str(tmp_path / str(i))), path).collect()})
    assert not any(out[1][i] for i, *_ in more)
    assert sum(out[0][i] != out[1][i] for i, *_ in docs) <= 2


def test_small_languages_have_bands_near_their_own(spark, tmp_path):
    import public_tokenizers

    rnd = random.Random(6)
    latin = [(r.doc_id, r.text, r.lang + str(r.doc_id % 3)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    word = lambda first, size, least, most: "".join(chr(first + rnd.randrange(size)) for _ in range(rnd.randrange(least, most)))
    lexicon = {"zh": [word(0x4E00, 400, 1, 4) for _ in range(600)], "ko": [word(0xAC00, 2000, 2, 5) for _ in range(600)]}
    clean = [(10**6 + 1000 * k + i, " ".join(rnd.choices(x, k=rnd.randrange(80, 300))), lang) for k, (lang, x) in enumerate(lexicon.items()) for i in range(60)]
    spark.createDataFrame(latin + clean, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "t"))
    out = {r.doc_id: r.kept for r in Q.quality_rules(spark.read.parquet(str(tmp_path / "t")), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert sum(out[i] for i, *_ in clean) >= 0.97 * len(clean)
    assert [Q.script(x) for x in ("Straße 12", "12 #", "漢字", "漢字かな", "한국어 ok", "Привет")] == ["LATIN", "", "CJK", "KANA", "HANGUL", "CYRILLIC"]


def test_fertility_kept_by_its_definition(spark):
    """Bands of languages, one of them null and one of a single text, drawn towards their scripts'."""
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        lang = rnd.choice(["a", "a", "a", "b", None, ""]) if i else "lone"
        script = "LATIN" if lang != "b" else "GREEK"
        n = rnd.randrange(60, 900)
        rows.append((i, lang, n, 5 * n, 0, 0, 0, n + rnd.randrange(200), rnd.gauss(4 + (lang == "b"), 0.2), abs(rnd.gauss(0, 0.01)), min(1.0, rnd.gauss(0.9, 0.02)), script, str(i % 300).encode()))
    rows = [next(r for r in rows if r[1] == x[1] and r[-1] == x[-1])[1:] for x in rows]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(900, "a", 3, 9, 0, 0, 0, 4, 2.25, 0.0, 1.0, "LATIN", b"x"), (901, None, 0, 0, 0, 0, 0, 0, None, None, None, "", b"")]
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, text_key binary"
    got = {r.doc_id: r.kept for r in Q.judged(written(spark.createDataFrame(rows, schema), "t")).collect()}
    texts = list({(r[1], r[-1]): (r[1], r[-2], r[7], *r[8:11]) for r in rows if r[2] >= 50}.values())

    def facts(some):
        x, y = np.array([round(math.log2(t[2]), 8) for t in some]), np.array([round(t[5], 8) for t in some])
        wide = len(x) * (x * x).sum() - x.sum() ** 2
        slope = (len(x) * (x * y).sum() - x.sum() * y.sum()) / wide if wide > 1e-9 * len(x) * (x * x).sum() else 0.0
        f = {"n": len(x), "x": x.mean(), "y": y.mean(), "slope": slope, "c": np.median([round(t[3], 4) for t in some]), "b": np.median([round(t[4], 5) for t in some])}
        far = [[round((t[3] - f["c"]) * t[2] ** 0.5, 3) for t in some], [round((t[4] - f["b"]) * t[2] ** 0.5, 3) for t in some], [round(t[5] - (f["y"] - slope * f["x"]) - slope * math.log2(t[2]), 4) for t in some]]
        return f | {"q": [np.quantile(v, [0.25, 0.75]) for v in far]}

    for lang in {t[0] for t in texts}:
        own = facts([t for t in texts if t[0] == lang])
        pool = facts([t for t in texts if t[1] == ("GREEK" if lang == "b" else "LATIN")])
        n = own["n"]
        near = lambda a, b, pull, n=n: b + (a - b) * n / (n + pull)
        slope = near(own["slope"], pool["slope"], 50)
        level = near(own["y"] - slope * own["x"], pool["y"] - slope * pool["x"], 5)
        for r in rows:
            if r[1] == lang and r[2] >= 50:
                d = [(r[8] - near(own["c"], pool["c"], 5)) * r[7] ** 0.5, (r[9] - near(own["b"], pool["b"], 5)) * r[7] ** 0.5, r[10] - level - slope * math.log2(r[7])]
                ok = True
                for value, a, b, least, (down, up) in zip(d, own["q"], pool["q"], (0.5, 0.25, 0.02), Q.REACH.values()):
                    low, high = near(a[0], b[0], 50), near(a[1], b[1], 50)
                    wide = max(high - low, least)
                    ok &= low - wide * down <= value <= high + wide * up
                assert got[r[0]] == ok, r
    assert not got[900] and not got[901] and 0 < sum(got.values()) < len(got)


def test_words_of_a_set_phrase_are_learned(spark, tmp_path):
    """Toxic texts that share one phrase: its words always follow the same word. One of the texts has many copies."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("aeiklmnrst", k=5)) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(400)]
    rows = [(i, x.replace(" ", " the worthless idiot ", 1) if i < 100 else x) for i, x in enumerate(texts)]
    rows += [(1000 + i, rows[0][1] + " onlyhere") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert min(model.scores[w] for w in ("worthless", "idiot")) > 0 and model.scores.get("onlyhere", -25) <= 0
    out = {r.doc_id: r for r in T.score_texts(docs, model).collect()}
    assert all(out[i].predicted == (i < 100 or i >= 1000) for i, _ in rows)
    assert all(out[i].n_passages for i in range(100))
