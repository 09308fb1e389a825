"""Encodes texts with the files of public tokenizers, each distinct unit once.

Words repeat far more often than texts do, so a worker remembers the units it has encoded, up to a bound. A unit is
what the library itself encodes apart from the rest of the text:

* word_bpe_49k drops white space and splits at it, so the result for a text is the join of the results for its
  words. In texts of plain Latin letters it also splits letters, digits and signs from one another, which leaves fewer
  distinct units; every other text is taken word by word.
* The sentencepiece file is used on single words by the quality rules, whose measures are defined on words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from .common import WORD_PATTERN

WORDS = re.compile(WORD_PATTERN)
#: Most units in each of a worker's two generations, and the longest of them in characters.
REMEMBER, LONGEST = 300_000, 48
#: Vocabularies whose result for a text is the join of the results for its words.
WORDWISE = ("word_bpe_49k.json",)

#: Texts of these characters need no Unicode composition, are lowered letter by letter, and are split by UNITS.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_LETTERS = "a-zß-öø-ÿ"
UNITS = re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_LETTERS}0-9]+|[0-9]")


@lru_cache(maxsize=4)
def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return coder


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text, as the library for this file gives them: no special tokens added, no truncation, no padding."""
    coder = loaded(path)
    if path.endswith(".model"):
        return coder.encode(texts, num_threads=1)
    return [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def _ends(path: str) -> np.ndarray:
    vocabulary = loaded(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        ends[i] = token.endswith("</w>")
    return ends


def cut_lengths(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    return np.diff(ends, prepend=0).tolist()


def cut_packed(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each unit's ids."""
    raw, width = ids.tobytes(), ids.itemsize
    at = [0, *(ends * width).tolist()]
    return [raw[i:j] for i, j in zip(at, at[1:])]


#: What is kept of a unit's ids: how to cut it from the ids of many units, given their ends; and how a text's are joined.
KINDS = {"length": (cut_lengths, sum), "ids": (cut_packed, b"".join), "ids16": (lambda ids, ends: cut_packed(ids.astype("<u2"), ends), b"".join)}


def encode_units(path: str, units: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units, and where each unit's end. Plain ones go in one call: their last tokens are marked."""
    if plain:
        ids = np.array(encode(path, [" ".join(units)])[0], dtype="<u4")
        ends = np.flatnonzero(_ends(path)[ids]) + 1
        if len(ends) == len(units):
            return ids, ends
    every = encode(path, units)
    ends = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))
    return np.fromiter((i for x in every for i in x), "<u4", int(ends[-1]) if len(ends) else 0), ends


class _Generation(dict):
    """A dict that takes what it lacks from the generation before it."""

    old: dict

    def __missing__(self, unit):
        value = self[unit] = self.old[unit]
        return value


class Memo:
    """unit -> what `kind` keeps of its ids. Units that were not met for a whole generation are forgotten."""

    def __init__(self, path: str, kind: str, plain: bool):
        self.path, self.plain = path, plain
        self.cut, self.join = KINDS[kind]
        self.known = _Generation()
        self.known.old = {}

    def learn(self, units: set[str]) -> None:
        known = self.known
        new = list(units.difference(known).difference(known.old))
        if len(known) + len(new) > REMEMBER:
            self.known = _Generation()
            self.known.old = {u: v for u, v in known.items() if len(u) <= LONGEST}
            known, new = self.known, list(units.difference(self.known.old))
        if new:
            known.update(zip(new, self.cut(*encode_units(self.path, new, self.plain))))

    def fold(self, lists: list[list[str]]) -> list:
        """What each list's units give together. Most texts have a unit that is new, so all are looked up first."""
        self.learn(set().union(*lists))
        get, join = self.known.__getitem__, self.join
        return [join(map(get, units)) for units in lists]


@lru_cache(maxsize=12)
def memo(path: str, kind: str, plain: bool) -> Memo:
    return Memo(path, kind, plain)


def n_bytes(text: str | None) -> int:
    """Bytes of a text in UTF-8."""
    return 0 if not text else len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def by_bytes(texts: Iterable[str | None], most: int) -> Iterator[list[str]]:
    """Batches of at most `most` bytes or one text; null is an empty text."""
    batch, held = [], 0
    for text in texts:
        text = text or ""
        size = n_bytes(text)
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


def split_safely(text: str, most: int) -> Iterator[str]:
    """Pieces of about `most` characters at most, cut only where white space stands; a longer word stays whole.

    The white space at a cut goes: the pieces' words are the text's words.
    """
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at + 1, at + most) for c in " \n\t\r\x0b\x0c")
        if cut < 0:
            found = re.compile(r"[ \t-\r]").search(text, at + most)
            if not found:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def fold_texts(texts: list[str], path: str, kind: str, piece: int = 1 << 18) -> list:
    """For a WORDWISE vocabulary: the length or the packed ids of each text, the same as of encoding it whole."""
    plain, other, owner = [], [], []
    for i, text in enumerate(texts):
        for part in split_safely(text, piece) if len(text) > piece else (text,):
            if PLAIN.fullmatch(part) and "<|" not in part:
                plain.append(UNITS.findall(part.lower()))
                owner.append((i, True))
            else:
                other.append(WORDS.findall(part))
                owner.append((i, False))
    done = {True: iter(memo(path, kind, True).fold(plain)), False: iter(memo(path, kind, False).fold(other))}
    if len(owner) == len(texts):
        return [next(done[p]) for _, p in owner]
    parts: list[list] = [[] for _ in texts]
    for i, p in owner:
        parts[i].append(next(done[p]))
    return [KINDS[kind][1](x) for x in parts]
