"""Column expressions on nucleotide strings over A, C, G, T and N."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(raw) -> Column:
    """Upper-case sequence of raw sequence text: characters up to code 64 vanish, other letters than ACGT become N."""
    return F.regexp_replace(F.upper(F.regexp_replace(_c(raw), r"[^A-Za-z\[-\x{10FFFF}]", "")), "[^ACGT]", "N")


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def canonical(kmer) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_c(kmer), reverse_complement(kmer))


def is_reverse(kmer) -> Column:
    """Whether the canonical form is the reverse complement; a palindrome is forward."""
    return _c(kmer) > reverse_complement(kmer)


def pack(kmer) -> Column:
    """Two bits a base as a long (31 bases at most); null if any base is N."""
    return F.when(~_c(kmer).contains("N"), F.conv(F.translate(_c(kmer), "ACGT", "0123"), 4, 10).cast("long"))


def auto_k(total_length) -> Column:
    """ceil(1 + log4 of the total length)."""
    return F.ceil(1 + F.log(_c(total_length)) / math.log(4.0)).cast("int")


def entropy(kmer) -> Column:
    """Sum of p ln p over the four bases: 0 for one base only, -1.386 for a balanced mix."""

    def of(s: Column) -> Column:
        n = F.length(s)

        def part(base: str) -> Column:
            p = (n - F.length(F.replace(s, F.lit(base), F.lit("")))) / n
            return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))

        return part("A") + part("C") + part("G") + part("T")

    # bound once: pushed below other expressions, the k-mer would be computed again at each of its twelve uses
    return F.transform(F.array(_c(kmer)), of)[0]


def low_entropy(kmer, most: float = -0.70) -> Column:
    return entropy(kmer) > most


def periodic(kmer, least_compared: int = 4, percent: int = 85) -> Column:
    """Whether, for a shift of up to half the length, ``percent`` of the positions equal those at the shift."""
    s, n = _c(kmer), F.length(_c(kmer))

    def equal_at(p: Column) -> Column:
        same = F.filter(F.sequence(F.lit(1), n - p), lambda i: F.substring(s, i, F.lit(1)) == F.substring(s, i + p, F.lit(1)))
        return (n - p >= least_compared) & (F.size(same) * 100 >= (n - p) * percent)

    return F.when(n < 4, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), equal_at))


def gc_fraction(seq) -> Column:
    """Share of G and C among A, C, G and T; null if there is none of these."""
    known = F.length(F.translate(_c(seq), "N", ""))
    return F.when(known > 0, F.length(F.regexp_replace(_c(seq), "[^GC]", "")) / known)


def wrap(seq, width: int = 80) -> Column:
    """The sequence in lines of ``width`` characters."""
    return F.rtrim(F.regexp_replace(_c(seq), f"(.{{{width}}})", "$1\n"), F.lit("\n"))
