"""Contacts between ends of sequences."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import zone, zone_borders
from .iterate import running, settled


def with_zones(contigs: DataFrame, ignore_middle: bool = True) -> DataFrame:
    """contigs (tid, name, len, ...) with the borders left and right of their end zones."""
    left, right = zone_borders(F.col("len"), ignore_middle)
    return contigs.withColumn("left", left).withColumn("right", right)


def with_ends(hits: DataFrame, contigs: DataFrame, ignore_middle: bool = True) -> DataFrame:
    """hits with end1 and end2 (null in the middle), the lengths and the zones' sizes."""
    zones = with_zones(contigs, ignore_middle)
    side = lambda i: zones.select(F.col("tid").alias(f"id{i}"), F.col("len").alias(f"len{i}"), F.col("left").alias(f"left{i}"), F.col("right").alias(f"right{i}"))
    ends = [zone(F.col(f"pos{i}"), F.col(f"left{i}"), F.col(f"right{i}")).alias(f"end{i}") for i in (1, 2)]
    return hits.join(side(1), "id1").join(side(2), "id2").select("*", *ends)


def zone_counts(hits: DataFrame, contigs: DataFrame, ignore_middle: bool = True) -> DataFrame:
    """(id, zone, n): how many ends of hits fall into each zone; "." is the middle."""
    ends = with_ends(hits, contigs, ignore_middle)
    rows = ends.select(F.inline(F.array(*[F.struct(F.col(f"id{i}").alias("id"), F.coalesce(f"end{i}", F.lit(".")).alias("zone")) for i in (1, 2)])))
    return rows.groupBy("id", "zone").agg(F.count(F.lit(1)).alias("n"))


def contact_matrix(hits: DataFrame, contigs: DataFrame, ignore_middle: bool = True, by_distance: bool = False) -> DataFrame:
    """(id1, end1, id2, end2, weight, zone2, zone1, n): every hit counts in both directions.

    With ``by_distance`` a hit weighs one over the summed distances to its two ends.  A hit
    within one end of a sequence adds to its cell twice.
    """
    ends = with_ends(hits, contigs, ignore_middle).filter("end1 is not null and end2 is not null")
    away = lambda i: F.when(F.col(f"end{i}") == "+", F.col(f"pos{i}")).otherwise(F.col(f"len{i}") - F.col(f"pos{i}"))
    weight = F.try_divide(F.lit(1.0), (away(1) + away(2)).cast("double")) if by_distance else F.lit(1.0)
    cell = lambda i, j: F.struct(
        F.col(f"id{i}").alias("id1"), F.col(f"end{i}").alias("end1"), F.col(f"id{j}").alias("id2"), F.col(f"end{j}").alias("end2"),
        F.col(f"left{j}").alias("zone2"), F.col(f"left{i}").alias("zone1"), F.col("weight"),
    )
    both = ends.withColumn("weight", weight).select(F.inline(F.array(cell(1, 2), cell(2, 1))))
    summed = both.groupBy("id1", "end1", "id2", "end2", "zone2", "zone1").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return summed.select("id1", "end1", "id2", "end2", "weight", "zone2", "zone1", "n")


def named(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links by name: (ctg1, end1, ctg2, end2, weight, zone2, zone1, n); circular sequences have none."""
    straight = contigs.filter(~F.col("is_circ")) if "is_circ" in contigs.columns else contigs
    side = lambda i: straight.select(F.col("tid").alias(f"id{i}"), F.col("name").alias(f"ctg{i}"))
    return links.filter("weight <> 0").join(side(1), "id1").join(side(2), "id2").select("ctg1", "end1", "ctg2", "end2", "weight", "zone2", "zone1", "n")


def binned(pairs: DataFrame, width: int = 1000) -> DataFrame:
    """Map export: (s1, bin1, s2, bin2, n) of lifted pairs, sides ordered by scaffold, then position."""
    side = lambda i: F.struct(F.col(f"s{i}").alias("s"), F.floor((F.col(f"p{i}")) / width).alias("bin"))
    return pairs.select(F.least(side(1), side(2)).alias("a"), F.greatest(side(1), side(2)).alias("b")).groupBy(
        F.col("a.s").alias("s1"), F.col("a.bin").alias("bin1"), F.col("b.s").alias("s2"), F.col("b.bin").alias("bin2")
    ).agg(F.count(F.lit(1)).alias("n"))


def zoomed(bins: DataFrame, factor: int) -> DataFrame:
    """Coarser bins from finer ones, without going back to the pairs."""
    coarse = lambda c: F.floor(F.col(c) / factor).alias(c)
    return bins.groupBy("s1", coarse("bin1"), "s2", coarse("bin2")).agg(F.sum("n").alias("n"))


def zoom_levels(longest: int, width: int = 1000, factor: int = 2) -> list[int]:
    """Widths from ``width`` on, each ``factor`` times the one before, up to the first whose bin holds the longest sequence."""
    widths = [width]
    while widths[-1] <= longest:  # positions go from 0 to the length
        widths.append(widths[-1] * factor)
    return widths


def zoom_pyramid(pairs: DataFrame, sizes: DataFrame, width: int = 1000, factor: int = 2) -> DataFrame:
    """Map export at all zooms: (level, width, s1, bin1, s2, bin2, n) of lifted pairs on scaffolds (scf, len).

    Level 0 counts the pairs; every other one sums the bins of the level before it, which is
    written once, so that each is read from a table that is smaller than the one before.  The
    last level has one bin for each pair of scaffolds.  Without scaffolds there is level 0 alone.
    """
    longest = sizes.agg(F.max("len")).first()[0] or 0
    levels, bins = [], binned(pairs, width)
    for level, wide in enumerate(zoom_levels(longest, width, factor)):
        bins = settled(bins if level == 0 else zoomed(bins, factor))
        levels.append(bins.select(F.lit(level).alias("level"), F.lit(wide).cast("long").alias("width"), "s1", "bin1", "s2", "bin2", "n"))
    return reduce(DataFrame.unionByName, levels)


#: The longest axis of the map format, the widths of its bins in bases, the least mapping quality of its pairs.
AXIS, WIDTHS, MAP_MAPQ = 2_100_000_000, (2_500_000, 1_000_000, 500_000, 250_000, 100_000, 50_000, 25_000, 10_000, 5_000, 1_000), 1


def axis(sizes: DataFrame) -> DataFrame:
    """(scf, len, start) of scaffolds (scf, len) on one axis, the longest first."""
    return running(sizes.select("scf", "len"), [F.desc("len"), F.col("scf")], F.col("len")).withColumnRenamed("before", "start")


def axis_scale(sizes: DataFrame) -> int:
    """By how much positions are divided so that the axis fits; bin widths are divided by it too."""
    return 1 + (sizes.agg(F.sum("len")).first()[0] or 0) // AXIS


def on_axis(lifted: DataFrame, sizes: DataFrame, scale: int) -> DataFrame:
    """(qname, strand1, x1, strand2, x2, q1, q2) of lifted pairs, the side of the smaller scaffold first."""
    starts = axis(sizes)
    side = lambda i: starts.select(F.col("scf").alias(f"s{i}"), F.col("start").alias(f"start{i}"))
    x = lambda i: F.struct(F.col(f"s{i}").alias("s"), F.floor((F.col(f"p{i}") + F.col(f"start{i}")) / scale).alias("x"), F.when(F.col(f"r{i}"), 1).otherwise(0).alias("strand"), F.col(f"q{i}").alias("q"))
    joined = lifted.join(side(1), "s1").join(side(2), "s2")
    turned = F.col("s1") > F.col("s2")
    sides = joined.select("qname", F.when(turned, x(2)).otherwise(x(1)).alias("a"), F.when(turned, x(1)).otherwise(x(2)).alias("b"))
    return sides.select("qname", F.col("a.strand").alias("strand1"), F.col("a.x").alias("x1"), F.col("b.strand").alias("strand2"), F.col("b.x").alias("x2"), F.col("a.q").alias("q1"), F.col("b.q").alias("q2"))


def axis_map(lifted: DataFrame, sizes: DataFrame, scale: int, widths: tuple[int, ...] = WIDTHS, min_mapq: int = MAP_MAPQ) -> DataFrame:
    """The one-axis map at all its widths: (width, bin_width, bin1, bin2, n), bin1 <= bin2.

    bin_width: the width on the axis, divided by the scale as positions are, and at least 1.
    Pairs are counted once, in cells of the largest width that divides all of these; the cells
    are then dealt to the bins of every width at once, summed before they are shuffled.  Both
    reads of a pair need the mapping quality.
    """
    wide = {w: max(1, w // scale) for w in widths}
    grid = math.gcd(*wide.values())
    placed = on_axis(lifted, sizes, scale).filter((F.col("q1") >= min_mapq) & (F.col("q2") >= min_mapq))
    cell = lambda c: F.floor(F.col(c) / grid)
    cells = placed.select(F.least(cell("x1"), cell("x2")).alias("a"), F.greatest(cell("x1"), cell("x2")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    level = lambda w: F.struct(F.lit(w).cast("long").alias("width"), F.lit(wide[w]).cast("long").alias("bin_width"), F.floor(F.col("a") / (wide[w] // grid)).alias("bin1"), F.floor(F.col("b") / (wide[w] // grid)).alias("bin2"))
    dealt = cells.select("n", F.inline(F.array(*[level(w) for w in widths])))
    return dealt.groupBy("width", "bin_width", "bin1", "bin2").agg(F.sum("n").alias("n"))


def axis_sizes(sizes: DataFrame, scale: int) -> DataFrame:
    """(name, len): the map's only sequence, as long as all scaffolds (scf, len) on the axis."""
    return sizes.agg(F.floor(F.coalesce(F.sum("len"), F.lit(0)) / scale).alias("len")).select(F.lit("assembly").alias("name"), "len")
