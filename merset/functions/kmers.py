"""k-mers as numbers: two bits a base, the first base most significant, so numeric order is alphabetical.

All expressions are built-in functions over BIGINT codes (``enc``), good for
k up to 30: a code has 60 bits, a vertex with its tag 62.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merset.session import built_once

BASES = "ACGT"
#: A one in the low bit of each of 31 digits.
_LOW_BITS = 0x1555555555555555


def decode(enc: Column, k: int) -> Column:
    """27 with k=4 is ACGT."""
    return F.translate(F.lpad(F.conv(enc.cast("string"), 10, 4), k, "0"), "0123", BASES)


def encode(kmer: Column) -> Column:
    """ACGT is 27; null for null, empty and too long strings and those with other letters."""
    return F.when(kmer.rlike("^[ACGT]{1,30}$"), F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("bigint"))


def profile(kmer: Column, k: int) -> dict[str, Column]:
    """da, dc, dg, dt: k less the count of each base, which is the distance to its homopolymer in both metrics."""
    return {f"d{x.lower()}": (F.length(F.replace(kmer, F.lit(x), F.lit(""))) + (k - F.length(kmer))).cast("int") for x in BASES}


def low(enc: Column, m: int) -> Column:
    """The last m bases."""
    return enc.bitwiseAND(F.lit((1 << (2 * m)) - 1))


def substitutions(enc: Column, k: int) -> Column:
    """All k-mers that differ from ``enc`` in one base, as an array of 3k codes."""
    out = []
    for j in range(k):
        digit = F.shiftright(enc, 2 * j).bitwiseAND(F.lit(3))
        out += [enc - F.shiftleft(digit, 2 * j) + F.shiftleft(F.pmod(digit + step, F.lit(4)), 2 * j) for step in (1, 2, 3)]
    return F.array(*out)


def deletions(enc: Column, k: int) -> Column:
    """The distinct (k-1)-mers that lack one base of ``enc``."""
    return F.array_distinct(F.array(*[F.shiftleft(F.shiftright(enc, 2 * j), 2 * (j - 1)) + low(enc, j - 1) for j in range(1, k + 1)]))


def insertions(enc: Column, k: int) -> Column:
    """The distinct k-mers that have one base more than the (k-1)-mer ``enc``; 3k + 1 of them."""
    return F.array_distinct(F.array(*[F.shiftleft(F.shiftright(enc, 2 * j), 2 * (j + 1)) + F.lit(b << (2 * j)).cast("bigint") + low(enc, j) for j in range(k) for b in range(4)]))


def vertex(enc: Column, is_kmer: bool = True) -> Column:
    """Code and tag in one number: the low two bits are 1 for a k-mer, 0 for a (k-1)-mer."""
    return F.shiftleft(enc, 2) + F.lit(int(is_kmer))


def is_kmer(vid: Column) -> Column:
    return vid.bitwiseAND(F.lit(3)) == 1


def code_of(vid: Column) -> Column:
    return F.shiftright(vid, 2)


def hamming(a: Column, b: Column) -> Column:
    """Bases in which two codes differ."""
    z = a.bitwiseXOR(b)
    return F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(F.lit(_LOW_BITS)))


def distance(metric: str, a: str, b: str) -> Column:
    """Exact distance of sides ``a`` and ``b`` (each with enc and kmer)."""
    if metric == "hamming":
        return hamming(F.col(f"{a}.enc"), F.col(f"{b}.enc"))
    return F.levenshtein(F.col(f"{a}.kmer"), F.col(f"{b}.kmer"))


def within(metric: str, d: int, a: str, b: str) -> Column:
    """Whether the distance is at most d; for edits, banded (above the threshold ``levenshtein`` gives -1)."""
    if metric == "hamming":
        return distance(metric, a, b) <= d
    return F.levenshtein(F.col(f"{a}.kmer"), F.col(f"{b}.kmer"), d) >= 0


def pivot_distances(metric: str, pivots: tuple[str, ...]) -> dict[str, Column]:
    """p0, p1, ...: a row's distance (enc, kmer) to each of some fixed k-mers."""
    codes = [sum(BASES.index(x) * 4**i for i, x in enumerate(reversed(p))) for p in pivots]
    if metric == "hamming":
        return {f"p{i}": hamming(F.col("enc"), F.lit(c).cast("bigint")).cast("int") for i, c in enumerate(codes)}
    return {f"p{i}": F.levenshtein("kmer", F.lit(p)) for i, p in enumerate(pivots)}


def _references(pivots: int) -> list[str]:
    return ["da", "dc", "dg", "dt", *[f"p{i}" for i in range(pivots)]]


@built_once
def lower_bound(a: str, b: str, pivots: int = 0) -> Column:
    """Largest difference of the distances to the four k-mers of one base (and to pivots): no distance is smaller."""
    return F.greatest(*[F.abs(F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) for x in _references(pivots)])


@built_once
def upper_bound(a: str, b: str, pivots: int = 0) -> Column:
    """Smallest sum of the distances to the four k-mers of one base (and to pivots): no distance is larger."""
    return F.least(*[F.col(f"{a}.{x}") + F.col(f"{b}.{x}") for x in _references(pivots)])


def check_domain(k: int, d: int | None = None) -> None:
    if not 2 <= k <= 30:
        raise ValueError("k must be from 2 to 30")
    if d is not None and not 1 <= d < k:
        raise ValueError("d must be from 1 to k - 1")
