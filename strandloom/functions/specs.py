"""Alphabets and seeds: small immutable descriptions that plans are built from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import floor, log

import numpy as np

# The classes of each alphabet; a class's place is its code. One letter may stand in one class only.
ALPHABETS = {
    "AMINO20": ["A", "C", "D", "E", "F", "G", "H", "I", "K", "L", "M", "N", "P", "Q", "R", "S", "T", "V", "W", "Y"],
    "SEB14": ["A", "C", "D", "EQ", "FY", "G", "H", "IV", "KR", "LM", "N", "P", "ST", "W"],
    "SEB10": ["AST", "C", "DN", "EQ", "FY", "G", "HW", "ILMV", "KR", "P"],
    "SEV10": ["AST", "C", "DEN", "FY", "G", "H", "ILMV", "KQR", "P", "W"],
    "SOLISD": ["AM", "C", "DNS", "EKQR", "F", "GP", "HT", "IV", "LY", "W"],
    "SOLISG": ["AEFIKLMQRVW", "C", "D", "G", "H", "N", "P", "S", "T", "Y"],
    "MURPHY": ["A", "C", "DENQ", "FWY", "G", "H", "ILMV", "KR", "P", "ST"],
    "LIA10": ["AC", "DE", "FWY", "G", "HN", "IV", "KQR", "LM", "P", "ST"],
    "LIB10": ["AST", "C", "DEQ", "FWY", "G", "HN", "IV", "KR", "LM", "P"],
    "SEB8": ["AST", "C", "DHN", "EKQR", "FWY", "G", "ILMV", "P"],
    "SEB6": ["AST", "CP", "DHNEKQR", "FWY", "G", "ILMV"],
    "DAYHOFF": ["AGPST", "C", "DENQ", "FWY", "HKR", "ILMV"],
    "DNA4": ["A", "C", "G", "T"],
    "DNA5": ["A", "C", "G", "T", "NMRWSYKVHDB"],
    "DNA2KETAMINE": ["ACM", "KGT"],
    "DNA2PYRPUR": ["AGR", "YCT"],
    "DNA2METHYL": ["C", "AGT"],
}
# Other names of the same alphabets.
ALIASES = {"DNA": "DNA4", "AMINO": "AMINO20", "PROTEIN": "AMINO20", "PROTEIN20": "AMINO20", "PROTEIN_3BIT": "SEB8", "PROTEIN8": "SEB8", "PROTEIN_14": "SEB14", "PROTEIN_6": "SEB6", "KETO": "DNA2KETAMINE", "DNA2": "DNA2KETAMINE", "PURPYR": "DNA2PYRPUR", "DNAMETH": "DNA2METHYL", "DNAC": "DNA2METHYL"}
# Letters that stand for another, where their own has no class.
STAND_IN = {"protein": {"O": "K", "U": "C"}, "dna": {"U": "T"}}


@dataclass(frozen=True)
class Alphabet:
    name: str
    classes: tuple[str, ...]

    @property
    def base(self) -> int:
        return 256 if self.name == "BYTES" else len(self.classes)

    def lut(self) -> np.ndarray:
        """Code of each byte, -1 for none; upper and lower case alike."""
        return _lut(self.name)

    def most_k(self, bits: int = 63) -> int:
        """The longest k-mer that fits in so many bits."""
        return floor(bits * log(2) / log(self.base) + 1e-9)

    def letters(self) -> tuple[str, str]:
        """For translate(): every letter, and the first letter of its class."""
        pairs = [(x, c[0]) for c in self.classes for x in c]
        known = {x for x, _ in pairs}
        kind = "dna" if self.name.startswith("DNA") else "protein"
        for x, y in STAND_IN[kind].items():
            if x not in known and y in known:
                pairs.append((x, next(c[0] for c in self.classes if y in c)))
        return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


@lru_cache(maxsize=None)
def _lut(name: str) -> np.ndarray:
    if name == "BYTES":
        return np.arange(256, dtype=np.int16)
    one = alphabet(name)
    out = np.full(256, -1, np.int16)
    code = {x: i for i, c in enumerate(one.classes) for x in c}
    for x, y in zip(*one.letters()):
        for letter in (x, x.lower()):
            out[ord(letter)] = code[y]
    return out


def alphabet(name: str) -> Alphabet:
    name = ALIASES.get(name.upper(), name.upper())
    if name == "BYTES":
        return Alphabet(name, ())
    if name not in ALPHABETS:
        raise ValueError(f"no alphabet is called {name}")
    return Alphabet(name, tuple(ALPHABETS[name]))


def parse_spacing(text: str, k: int) -> tuple[int, ...]:
    """The k - 1 gaps of a seed from a comma list, where `gap x times` repeats one: "1,2,0x28". Empty: no gaps."""
    if not text:
        return (0,) * (k - 1)
    gaps: list[int] = []
    for part in text.split(","):
        gap, _, times = part.partition("x")
        gaps += [int(gap)] * (int(times) if times else 1)
    if len(gaps) != k - 1:
        raise ValueError(f"{text} has {len(gaps)} gaps; a seed of {k} has {k - 1}")
    return tuple(gaps)


def show_spacing(gaps: tuple[int, ...]) -> str:
    """The shortest comma list that parse_spacing() reads back."""
    runs: list[list[int]] = []
    for g in gaps:
        if runs and runs[-1][0] == g:
            runs[-1][1] += 1
        else:
            runs.append([g, 1])
    return ",".join(str(g) if n == 1 else f"{g}x{n}" for g, n in runs)


@dataclass(frozen=True)
class Seed:
    """k positions with gaps between them, in windows of w positions, over an alphabet."""

    k: int
    w: int = 0
    gaps: tuple[int, ...] = ()
    canonical: bool = True
    alphabet: str = "DNA4"

    def __post_init__(self):
        if self.k < 1 or self.gaps and len(self.gaps) != self.k - 1:
            raise ValueError("a seed has k positions and k - 1 gaps")
        if self.k > alphabet(self.alphabet).most_k(64 if alphabet(self.alphabet).base == 256 else 63):
            raise ValueError(f"{self.k} letters of {self.alphabet} do not fit in a long")

    @property
    def spaced(self) -> bool:
        return any(self.gaps)

    @property
    def span(self) -> int:
        """Positions from the first to the last."""
        return self.k + sum(self.gaps)

    @property
    def window(self) -> int:
        """Seeds in a window: 1 if there is none."""
        return max(self.w, self.span) - self.span + 1

    @property
    def stranded(self) -> bool:
        """Gaps need not be symmetric and proteins have no other strand, so only plain DNA seeds are canonical."""
        return not self.canonical or self.spaced or alphabet(self.alphabet).name != "DNA4"

    def offsets(self) -> list[int]:
        out = [0]
        for g in self.gaps or (0,) * (self.k - 1):
            out.append(out[-1] + g + 1)
        return out
