"""Codons as residues, and reduced residue alphabets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, its bases in the order TCAG; fixed values.
BASES = "TCAG"
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Codons that are looked up in one piece.
PIECE = 128
#: Groups of residues in Dayhoff's classes and in hydrophobic or polar; fixed values.
DAYHOFF = {"a": "C", "b": "AGPST", "c": "DENQ", "d": "HKR", "e": "ILMV", "f": "FWY"}
HP = {"h": "AFGILMPVWY", "p": "CDEHKNQRST"}


def _place(base: Column) -> Column:
    return F.instr(F.lit(BASES), base) - 1


def translate_codon(codon: Column) -> Column:
    """A residue, ``*`` for a stop, ``X`` for a codon with another symbol; null unless it has three."""
    c = F.upper(codon)
    code = sum((_place(F.substring(c, i + 1, 1)) * 4 ** (2 - i) for i in range(3)), F.lit(0))
    known = F.substr(F.lit(RESIDUES), code + 1, F.lit(1))
    return F.when(F.length(c) == 3, F.when(c.rlike("^[ACGT]*$"), known).otherwise("X"))


def translate_sequence(sequence: Column, frame: int = 0) -> Column:
    """Residues of the whole codons from ``frame`` (0 to 2) on.

    A long sequence is cut first, as finding a place in it takes time in
    proportion to the place.
    """
    n = F.floor((F.length(sequence) - frame) / 3).cast("int")
    codon = lambda s: lambda i: translate_codon(F.substr(s, i * 3 + 1, F.lit(3)))
    of = lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 3).cast("int") - 1), codon(s)), "")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(starts, lambda i: F.substr(sequence, i * 3 + frame + 1, F.least(n - i, F.lit(PIECE)) * 3))
    return F.when(n > 0, F.array_join(F.transform(pieces, of), "")).otherwise(F.when(sequence.isNotNull(), ""))


def _reduced(residues: Column, groups: dict[str, str]) -> Column:
    known = "".join(groups.values())
    return F.translate(F.regexp_replace(F.upper(residues), f"[^{known}*]", "X"), known, "".join(g * len(m) for g, m in groups.items()))


def dayhoff(residues: Column) -> Column:
    """Residues as their Dayhoff classes; others are X, stops stay."""
    return _reduced(residues, DAYHOFF)


def hydrophobic_polar(residues: Column) -> Column:
    return _reduced(residues, HP)
