"""Column functions on sequences and their k-mers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kmers:
    """Length of k-mers and their alphabet; letters in lower case are those in upper case."""

    k: int = 4
    alphabet: str = "ACGT"

    def __post_init__(self) -> None:
        if self.k < 1 or not (self.alphabet.isascii() and self.alphabet.isalnum()) or len(set(self.alphabet.upper())) < len(self.alphabet):
            raise ValueError("an alphabet has different ASCII letters and digits, and k-mers have a letter at least")

    @property
    def size(self) -> int:
        """Length of a spectrum."""
        return len(self.alphabet) ** self.k

    @property
    def unique(self) -> int:
        """Classes of k-mers when each is one with its reversal (not its reverse complement)."""
        n = len(self.alphabet)
        return (n**self.k + n ** -(-self.k // 2)) // 2

    def all(self) -> list[str]:
        """All k-mers in lexicographic order of the alphabet."""
        found = [""]
        for _ in range(self.k):
            found = [w + a for w in found for a in self.alphabet]
        return found


def gc_fraction(sequence: Column) -> Column:
    """Share of G and C, upper case only; NULL for an empty sequence."""
    n = F.length(sequence)
    return F.try_divide(n - F.length(F.translate(sequence, "GC", "")), n)


def kmers(sequence: Column, by: Kmers) -> Column:
    """All overlapping k-mers of known letters, in order, in upper case."""
    upper = F.translate(sequence, by.alphabet.lower(), by.alphabet)
    return F.regexp_extract_all(upper, F.lit(f"(?=([{by.alphabet}]{{{by.k}}}))"), F.lit(1))


def kmer_rank(kmer: Column, by: Kmers) -> Column:
    """Place of a k-mer in a spectrum, -1 for one with unknown letters; another length than k raises."""
    n = len(by.alphabet)
    upper = F.translate(kmer, by.alphabet.lower(), by.alphabet)
    if 2 <= n <= 36:
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:n]
        value = F.conv(F.translate(upper, by.alphabet, digits), n, 10).cast("long")
    else:
        place = F.create_map(*[x for i, a in enumerate(by.alphabet) for x in (F.lit(a), F.lit(i))])
        value = F.aggregate(F.transform(F.split(upper, ""), lambda a: F.element_at(place, a)), F.lit(0).cast("long"), lambda s, x: s * n + x)
    known = F.when(upper.rlike(f"^[{by.alphabet}]*$"), value).otherwise(F.lit(-1).cast("long"))
    return F.when(F.length(kmer) == by.k, known).otherwise(F.raise_error(F.lit(f"a k-mer doesn't have {by.k} letters")))


def vector_rank(vector: Column, by: Kmers) -> Column:
    """Place of a k-mer given as an array of letter numbers."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda s, x: s * len(by.alphabet) + x)


def folded(kmer: Column) -> Column:
    """A k-mer or its reversal, whichever comes first."""
    return F.least(kmer, F.reverse(kmer))
