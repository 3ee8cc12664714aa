"""Alphabets: validation and complements as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """symbols and, place by place, their complements."""

    name: str
    symbols: str
    complements: str

    def __len__(self) -> int:
        return len(self.symbols)

    def is_valid(self, sequence: Column) -> Column:
        """Whether every symbol, of either case, is of the alphabet; a line end is a symbol too."""
        return F.lit(True) if not self.symbols else sequence.rlike(rf"^[{self.symbols}{self.symbols.lower()}]*\z")

    def validate(self, sequence: Column) -> Column:
        """Upper-cased sequence, null where a symbol is not of the alphabet."""
        return F.when(self.is_valid(sequence), F.upper(sequence))

    def complement(self, sequence: Column) -> Column:
        return F.translate(sequence, self.symbols, self.complements) if self.symbols else sequence

    def reverse_complement(self, sequence: Column) -> Column:
        """Of the ANY alphabet, the sequence itself."""
        return F.reverse(self.complement(sequence)) if self.symbols else sequence


#: Symbols and complements; fixed values of nucleotide notation.
DNA = Alphabet("DNA", "ACGT", "TGCA")
DNAN = Alphabet("DNAN", "ACGTN", "TGCAN")
IUPAC = Alphabet("IUPAC", "ATUGCYRSWKMBDHVN", "TAACGRYSWMKVHDBN")
ANY = Alphabet("ANY", "", "")
ALPHABETS = {a.name: a for a in (DNA, DNAN, IUPAC, ANY)}
