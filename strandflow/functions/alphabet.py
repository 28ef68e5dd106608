"""Letters, their indices and substitution matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets in index order, gaps, and the default scores.
NUCLEOTIDES = "ACGT"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
GAPS = "-."
MATCH, MISMATCH, TRANSITION = 18.0, -8.0, -4.0
GAP_OPEN, GAP_EXTEND = -50.0, -5.0


def letters_of(kind: str) -> str:
    return {"n": NUCLEOTIDES, "p": AMINO_ACIDS}[kind]


def letter_index(letter: Column, kind: str = "n") -> Column:
    """Index of an upper- or lower-case letter; the next index is the ambiguous class, the last one the gap."""
    letters = letters_of(kind)
    upper = F.upper(letter)
    if kind == "n":
        upper = F.when(upper == "U", "T").otherwise(upper)
    found = F.instr(F.lit(letters), upper)
    return F.when(letter.isin(*GAPS), len(letters) + 1).when(found > 0, found - 1).otherwise(len(letters)).cast("int")


def index_array(sequence: str, kind: str = "n") -> np.ndarray:
    letters = letters_of(kind)
    table = np.full(256, len(letters), np.int64)
    for k, c in enumerate(letters):
        table[ord(c)] = table[ord(c.lower())] = k
    if kind == "n":
        table[ord("U")] = table[ord("u")] = 3
    for c in GAPS:
        table[ord(c)] = len(letters) + 1
    return table[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]


def read_matrix(text: str, kind: str = "n", wildcard: bool = False) -> np.ndarray:
    """A matrix from white-space separated text: a line of letters, then rows of numbers, each with or without its letter.

    Without a row for the ambiguous letter, that scores the diagonal's mean with
    wildcard and 0 without.
    """
    letters = letters_of(kind)
    tokens = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    header = tokens[0]
    values = [[float(x) for x in row if x.lstrip("+-").replace(".", "", 1).isdigit()] for row in tokens[1:]]
    place = {c.upper(): k for k, c in enumerate(letters)} | {"N" if kind == "n" else "X": len(letters)}
    unknown = [c for c in header if c.upper() not in place and c not in "BZJOU*"]
    if unknown:
        raise ValueError(f"unknown letters in the matrix: {' '.join(unknown)}")
    n = len(letters) + 1
    out = np.full((n, n), np.nan)
    for a, row in zip(header, values, strict=False):
        for b, value in zip(header, row, strict=True):
            if a.upper() in place and b.upper() in place:
                out[place[a.upper()], place[b.upper()]] = value
    if np.isnan(out[:-1, :-1]).any():
        raise ValueError("the matrix lacks letters")
    fill = float(np.diag(out[:-1, :-1]).mean()) if wildcard else 0.0
    return np.where(np.isnan(out), fill, out)


def nucleotide_matrix(match: float = MATCH, mismatch: float = MISMATCH, transition: float = TRANSITION, wildcard: bool = False) -> np.ndarray:
    """5 x 5: A-G and C-T are transitions; the ambiguous class scores as a match with wildcard, else 0."""
    i = np.arange(4)
    out = np.full((5, 5), match if wildcard else 0.0)
    out[:4, :4] = np.where(i[:, None] == i, match, np.where(abs(i[:, None] - i) == 2, transition, mismatch))
    return out


@dataclass(frozen=True)
class Scoring:
    kind: str = "n"
    matrix: np.ndarray = field(default_factory=nucleotide_matrix)
    gap_open: float = GAP_OPEN
    gap_extend: float = GAP_EXTEND
    xdrop: float = 1000.0

    def __post_init__(self) -> None:
        if self.gap_open > 0 or self.gap_extend > 0:
            raise ValueError("gap penalties must not be positive")
        if self.xdrop <= 0:
            raise ValueError("xdrop must be positive")
        n = len(letters_of(self.kind)) + 1
        if self.matrix.shape != (n, n):
            raise ValueError(f"the matrix must be {n} x {n}")
