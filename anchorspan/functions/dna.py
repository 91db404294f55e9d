"""DNA text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letters whose complement is another letter, and those complements.
LETTERS = "ACGTRYKMBVDHacgtrykmbvdh"
COMPLEMENTS = "TGCAYRMKVBHDtgcayrmkvbhd"
IUPAC = "ACGTRYSWKMBVDHNacgtryswkmbvdhn"


def complement(col: Column) -> Column:
    """Each letter's complement; everything else (S, W, N and U, too) stays."""
    return F.translate(col, LETTERS, COMPLEMENTS)


def revcomp(col: Column) -> Column:
    return F.reverse(complement(col))


def is_dna(col: Column) -> Column:
    """Only IUPAC letters of either case. True for an empty text."""
    return col.rlike(rf"\A[{IUPAC}]*\z")


def read_revcomp(col: Column) -> Column:
    """Reverse complement of an aligned read: upper case, and N for whatever is not A, C, G or T."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(col), "[^ACGT]", "N"), "ACGT", "TGCA"))
