"""Column expressions of the domain: flags, zones, coordinates, sequences and significance.

An end of a contig is written as in the files: "+" is its left (head) end, "-" its right one.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the alignment flag.
UNMAPPED, REVERSE, FIRST_READ, SECOND_READ = 0x4, 0x10, 0x40, 0x80
#: Number of the CIGAR operation "M", and bases between neighbours in a scaffold.
MATCH, GAP = 0, 200
#: Nucleotide codes and their complements.
BASES, COMPLEMENTS = "ACGTUNRYSWKMBVDHacgtunryswkmbvdh", "TGCAANYRSWMKVBHDTGCAANYRSWMKVBHD"


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def five_prime(reverse: Column, first_op: Column, last_op: Column) -> Column:
    """The read's first base is aligned: a match stands at the end of the CIGAR where the read begins."""
    return F.when(reverse, last_op == MATCH).otherwise(first_op == MATCH)


def zone_borders(length: Column, ignore_middle: bool) -> tuple[Column, Column]:
    """Last base of the left zone and first base of the right one: thirds, or halves without a middle."""
    left = F.floor(length / (3 if ignore_middle else 2))
    right = F.floor(length * 2 / 3) + 1 if ignore_middle else left + 1
    return left.cast("long"), right.cast("long")


def zone(pos: Column, left: Column, right: Column) -> Column:
    """"+" up to the left border, null between the borders, "-" from the right one."""
    return F.when((left < pos) & (pos < right), F.lit(None)).when(pos <= left, F.lit("+")).otherwise(F.lit("-"))


def lift(pos: Column, offset: Column, forward: Column, length: Column) -> Column:
    """Position on the scaffold of a position on a contig that is placed on it."""
    return offset + F.when(forward, pos).otherwise(length - pos)


def opposite(end: Column) -> Column:
    return F.when(end == "+", F.lit("-")).otherwise(F.lit("+"))


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), BASES, COMPLEMENTS)


def clearly_more(best: Column, other: Column, level: float) -> Column:
    """Of best + other fair coin tosses, a count as large as best has a normal probability over ``level``.

    Spark has no error function; the test compares the z-score with the level's quantile.
    """
    total = best + other
    z = (best - total / 2) / F.sqrt(total / 4)
    return F.when(total > 0, z > NormalDist().inv_cdf(level)).otherwise(False)
