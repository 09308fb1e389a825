"""Quality rules by tokeniser fertility.

A public vocabulary splits every word of a text. Three measures follow: characters per token, the share of tokens that
are single bytes because the vocabulary has nothing better, and the entropy of the tokens relative to the most that so
many tokens can have. Each measure has a band per language, from all distinct texts of that language that pass the base
rules, so copies do not move it: a document outside the band is rejected. Since the first two are means over a text's tokens,
their distance from the language's median counts times the root of the number of tokens; entropy counts as what is left over
a line in the logarithm of that number. The band reaches beyond the quartiles.

A language's band is drawn towards that of its script (the one that most letters of most of its texts are of): the script
weighs as much as a few texts on the medians, and as some dozens on the quartiles, so it decides where there is hardly any
text and matters the less the more there is. Quantiles are exact for rounded values.

Every text is read once; the bands come from the table of measures, and one row per language goes back to the rows.

Defined results. Null or empty text: no words, base_failed, not kept, measures null. Null language: a language of its
own. Very long texts: whole. Repeated rows: rows of their own. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from functools import cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, join_checked, map_arrow, written
from .vocab import WORDS, by_bytes, loaded, memo

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: So many texts a language's script weighs as much as, on its medians and on its slope and quartiles.
PULL_MIDDLE, PULL_SPREAD = 5, 50
#: How many interquartile ranges a band reaches below the lower quartile and above the upper one. Few bytes and varied
#: tokens are no fault, so those sides are open.
REACH = {"chars_per_token": (4.0, 4.0), "byte_share": (inf, 4.0), "token_entropy": (2.5, inf)}
MEASURES = tuple(REACH)
#: The narrowest interquartile range of each distance: below it, spread is noise.
NARROWEST = {"chars_per_token": 0.5, "byte_share": 0.25, "token_entropy": 0.02}
#: Decimals that values and distances are rounded to before quantiles are taken.
DIGITS, FAR_DIGITS = {"chars_per_token": 4, "byte_share": 5}, {"chars_per_token": 3, "byte_share": 3, "token_entropy": 4}


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window which the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    sorted_ = windows[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


@cache
def sign_script(sign: str) -> str:
    """The script of a letter by its Unicode name, empty for any other sign; kana are one script."""
    if not sign.isalpha():
        return ""
    first = unicodedata.name(sign, "").partition(" ")[0]
    return {"HIRAGANA": "KANA", "KATAKANA": "KANA", "KATAKANA-HIRAGANA": "KANA", "HALFWIDTH": "KANA", "FULLWIDTH": "LATIN"}.get(first, first)


def script(text: str) -> str:
    """The script of most letters, empty without letters. Japanese, which mixes scripts, is known by its kana."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else ""
    n: Counter = Counter()
    for sign, times in Counter(text).items():
        n[sign_script(sign)] += times
    n.pop("", None)
    if not n:
        return ""
    best = max(n, key=lambda x: (n[x], x))
    return "KANA" if best == "CJK" and 10 * n["KANA"] >= n["CJK"] else best


def byte_tokens(path: str) -> np.ndarray:
    """Which ids are single bytes."""
    model = loaded(path)
    return np.array([model.is_byte(i) for i in range(model.vocab_size())])


def token_measures(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    n = len(ids)
    ordered = np.sort(ids, kind="stable")
    runs = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))))
    entropy = float(np.log2(n) - (runs * np.log2(runs)).sum() / n)
    return chars / n, float(is_byte[ids].mean()), entropy / float(np.log2(n)) if n > 1 else 0.0


def measured(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts and the three measures of every row; its script and a digest of its text."""
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES, "script", "text_key"]

    def kernel(batches):
        is_byte = byte_tokens(path)
        for batch in batches:
            rows: list[tuple] = []
            for texts in by_bytes(batch.column(1).to_pylist(), 1 << 20):
                lists = [WORDS.findall(t) for t in texts]
                packed = memo(path, "ids16", False).fold(lists)
                for text, words, ids in zip(texts, lists, packed):
                    chars = len(text) - sum(map(text.count, WHITE))
                    base = (len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words), len(ids) // 2)
                    key = script(text), hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                    rows.append(base + (token_measures(np.frombuffer(ids, "<u2"), chars, is_byte) if ids else (None, None, None)) + key)
            columns = list(zip(*rows)) if rows else [()] * 11
            types = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x, t) for x, t in zip(columns, types)]], names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in names[2:8]) + ", " + ", ".join(f"{c} double" for c in MEASURES) + ", script string, text_key binary"
    return map_arrow(rows, kernel, schema)


def once(rows: DataFrame) -> DataFrame:
    """One row per language and text. Copies are folded where they are read, so many of them are no large group."""
    return rows.dropDuplicates(["lang", "text_key"])


def quantiles(rows: DataFrame, value, at: list[float]) -> DataFrame:
    """band, q: exact quantiles of a rounded value, from how often each stands there."""
    return rows.groupBy("band", value.alias("value")).agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.percentile("value", at, F.col("n")).alias("q"))


def line(n, x, y, xx, xy):
    """Slope of the least-squares line, null if x is the same everywhere."""
    n, x, y, xx, xy = (c.cast("double") for c in (n, x, y, xx, xy))
    wide = n * xx - x * x
    return F.when(wide > 1e-9 * n * xx, (n * xy - x * y) / wide)


def distances(rows: DataFrame) -> dict:
    """Each measure's distance from the middle that stands in the same row: c_<measure>, c_level, c_slope."""
    root = F.sqrt("n_tokens")
    return {
        "chars_per_token": (F.col("chars_per_token") - F.col("c_chars_per_token")) * root,
        "byte_share": (F.col("byte_share") - F.col("c_byte_share")) * root,
        "token_entropy": F.col("token_entropy") - F.col("c_level") - F.col("c_slope") * F.log2("n_tokens"),
    }


def band_facts(texts: DataFrame) -> DataFrame:
    """band, n, middles, slope and quartiles of the distances of texts (band, n_tokens, measures). A written table, a row per band."""
    x, y = F.log2("n_tokens").cast("decimal(18,8)"), F.col("token_entropy").cast("decimal(18,8)")  # decimals add up to the same in any order
    facts = texts.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in (("x", x), ("y", y), ("xx", x * x), ("xy", x * y))])
    for m, digits in DIGITS.items():
        facts = facts.join(quantiles(texts, F.round(m, digits), [0.5]).select("band", F.col("q")[0].alias(f"c_{m}")), "band")
    mean_x, mean_y = (F.col(c).cast("double") / F.col("n") for c in ("x", "y"))
    slope = F.coalesce(line(*map(F.col, ("n", "x", "y", "xx", "xy"))), F.lit(0.0))
    facts = facts.select("band", "n", *[f"c_{m}" for m in DIGITS], mean_x.alias("mean_x"), mean_y.alias("mean_y"), slope.alias("c_slope"), (mean_y - slope * mean_x).alias("c_level"))
    facts = written(facts, "middles")
    placed = join_checked(texts, facts, "band", "inner")
    out = facts
    for m, d in distances(placed).items():
        out = out.join(quantiles(placed, F.round(d, FAR_DIGITS[m]), [0.25, 0.75]).select("band", F.col("q")[0].alias(f"q1_{m}"), F.col("q")[1].alias(f"q3_{m}")), "band")
    return written(out, "facts", facts)


def limits(texts: DataFrame) -> DataFrame:
    """band, the middles, low_<measure>, high_<measure> of each language, from its texts and those of its script."""
    own = texts.withColumn("band", language(F.col("lang")))
    script_of = own.groupBy("band", "script").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct(F.col("script") != "", F.col("n"), F.col("script"))).alias("top"))
    mine = band_facts(own)
    all_ = band_facts(texts.withColumn("band", F.col("script")))
    pool = all_.select(F.col("band").alias("script"), *[F.col(c).alias(f"s_{c}") for c in all_.columns if c != "band"])
    both = mine.join(script_of.select("band", F.col("top.script").alias("script")), "band").join(pool, "script")
    near = lambda c, pull: F.col(f"s_{c}") + (F.col(c) - F.col(f"s_{c}")) * F.col("n") / (F.col("n") + pull)
    slope = near("c_slope", PULL_SPREAD)
    level, s_level = (F.col(f"{p}mean_y") - slope * F.col(f"{p}mean_x") for p in ("", "s_"))
    columns = [near(f"c_{m}", PULL_MIDDLE).alias(f"c_{m}") for m in DIGITS] + [slope.alias("c_slope"), (s_level + (level - s_level) * F.col("n") / (F.col("n") + PULL_MIDDLE)).alias("c_level")]
    for m, (down, up) in REACH.items():
        q1, q3 = near(f"q1_{m}", PULL_SPREAD), near(f"q3_{m}", PULL_SPREAD)
        spread = F.greatest(q3 - q1, F.lit(NARROWEST[m]))
        columns += [(q1 - spread * down).alias(f"low_{m}"), (q3 + spread * up).alias(f"high_{m}")]
    return written(both.select("band", *columns), "limits")


def language(lang):
    """A name for each language, null being one."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def quality_rules(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, measures, base_failed and kept of every row."""
    return judged(written(measured(docs, path, id_col, text_col, lang_col), "measures"))


def judged(rows: DataFrame) -> DataFrame:
    """rows of measured() (a written table) with base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    texts = written(once(rows.filter(~failed)).select("lang", "script", "n_tokens", *MEASURES), "texts")
    placed = join_checked(rows.withColumns({"base_failed": failed, "band": language(F.col("lang"))}), limits(texts), "band", "left")
    inside = F.lit(True)
    for m, d in distances(placed).items():
        inside = inside & d.between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return placed.select(*[c for c in rows.columns if c not in ("script", "text_key")], "base_failed", kept.alias("kept"))


def op2_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
