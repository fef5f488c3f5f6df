"""Weights of links, their ranking at each end, and filters on the ranking.

Links: (ctg1, end1, ctg2, end2, weight, zone2, zone1, n).  Rankings have a total order, so
results do not depend on how rows are dealt: ties go to the smaller zone, then to names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clearly_more

#: The four cells of a pair of contigs, by end of the first and end of the second.
CELLS = [("mm", "-", "-"), ("mp", "-", "+"), ("pm", "+", "-"), ("pp", "+", "+")]


def with_lengths(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """links with len1 and len2; links of unknown contigs drop out (see ``unknown_contigs``)."""
    side = lambda i: contigs.select(F.col("name").alias(f"ctg{i}"), F.col("len").alias(f"len{i}"))
    return links.join(side(1), "ctg1").join(side(2), "ctg2")


def unknown_contigs(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Names in links that the contig list does not have; callers raise if there are any."""
    names = links.select(F.col("ctg1").alias("name")).union(links.select("ctg2")).distinct()
    return names.join(contigs.select("name"), "name", "left_anti")


def scale(ignore_middle: bool, product: bool) -> Column:
    zones = 3.0 if ignore_middle else 2.0
    if product:
        return F.lit(zones * zones) / (F.col("len1").cast("double") * F.col("len2").cast("double"))
    return F.lit(zones) / (F.col("len1") + F.col("len2")).cast("double")


def weigh(links: DataFrame, contigs: DataFrame, ignore_middle: bool = True, product: bool = False, min_weight: float = 0) -> DataFrame:
    """links with w: the count for each base of the zones; 0 if the count is not over ``min_weight``."""
    w = F.when(F.col("weight") > min_weight, F.col("weight") * scale(ignore_middle, product)).otherwise(0.0)
    return with_lengths(links, contigs).withColumn("w", w)


def cells(links: DataFrame, contigs: DataFrame, ignore_middle: bool = True, product: bool = False, min_weight: float = 0) -> DataFrame:
    """(ctg1, ctg2, mm, mp, pm, pp, hits, best): the weighed cells of each pair of contigs, the largest of them and its hits."""
    weighed = weigh(links, contigs, ignore_middle, product, min_weight)
    at = lambda a, b: F.coalesce(F.max(F.when((F.col("end1") == a) & (F.col("end2") == b), F.col("w"))), F.lit(0.0))
    found = weighed.groupBy("ctg1", "ctg2").agg(*[at(a, b).alias(name) for name, a, b in CELLS], F.max(F.when(F.col("w") > 0, F.col("weight"))).alias("hits"))
    return found.withColumn("best", F.greatest(*[name for name, *_ in CELLS]))


def counted_cells(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """(tid1, tid2, mm, mp, pm, pp): the cells of each pair of contigs (tid, name) as counts.

    The count of a link is its number of hits, or its weight where a file does not say the number.
    """
    hits = F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(F.col("weight"))
    at = lambda a, b: F.coalesce(F.sum(F.when((F.col("end1") == a) & (F.col("end2") == b), hits)), F.lit(0.0))
    side = lambda i: contigs.select(F.col("name").alias(f"ctg{i}"), F.col("tid").alias(f"tid{i}"))
    rows = links.groupBy("ctg1", "ctg2").agg(*[at(a, b).alias(name) for name, a, b in CELLS])
    return rows.join(side(1), "ctg1").join(side(2), "ctg2").select("tid1", "tid2", *[name for name, *_ in CELLS])


def ranked(weighed: DataFrame) -> DataFrame:
    """weighed links with ``rank`` among those of the same end, the heaviest first; weights of 0 are out."""
    order = Window.partitionBy("ctg1", "end1").orderBy(F.desc("w"), "zone2", "ctg2", "end2")
    return weighed.filter("w > 0").withColumn("rank", F.row_number().over(order))


def ranked_contigs(cell_rows: DataFrame) -> DataFrame:
    """cells with ``rank`` among those of the same first contig."""
    order = Window.partitionBy("ctg1").orderBy(F.desc("best"), "ctg2")
    return cell_rows.filter("best > 0").withColumn("rank", F.row_number().over(order))


def top(ranking: DataFrame, k: int) -> DataFrame:
    """The first k of each end (or contig)."""
    return ranking.filter(F.col("rank") <= k)


def over_count(ranking: DataFrame, min_weight: float) -> DataFrame:
    """Instead of the first k: all whose count reaches ``min_weight``."""
    return ranking.filter(F.col("weight") >= min_weight)


def significant(ranking: DataFrame, level: float = 0.95) -> DataFrame:
    """Ends whose first link has clearly more hits than the second; two links to one contig do not compete."""
    whole = Window.partitionBy("ctg1", "end1").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    link = F.struct("ctg2", "weight")
    seen = ranking.withColumn("first_", F.first(link).over(whole)).withColumn("second_", F.nth_value(link, 2).over(whole))
    alone = F.col("second_").isNull() | (F.col("second_.ctg2") == F.col("first_.ctg2"))
    return seen.filter(alone | clearly_more(F.col("first_.weight"), F.col("second_.weight"), level)).drop("first_", "second_")


def max_share(ranking: DataFrame, min_ratio: float) -> DataFrame:
    """Ends whose heaviest link holds this share of all their (ranked) hits; their links, with share."""
    whole = Window.partitionBy("ctg1", "end1")
    share = F.max("weight").over(whole) / F.sum("weight").over(whole)
    return ranking.withColumn("share", share).filter(F.col("share") >= min_ratio)


def end_normalised(links: DataFrame) -> DataFrame:
    """links with w: the count divided by the size of the other end's zone; 0 for an empty zone."""
    w = F.when(F.col("zone2") != 0, F.col("weight") / F.col("zone2").cast("double")).otherwise(0.0)
    return links.withColumn("w", w)


def per_zone_pair(links: DataFrame) -> DataFrame:
    """links with w: hits for each 100,000 pairs of positions of the two zones, for looking at."""
    area = F.col("zone1").cast("double") * F.col("zone2").cast("double")
    return links.withColumn("w", F.coalesce(F.try_divide(F.col("weight") * 1e5, area), F.lit(0.0)))


def end_table(ranking: DataFrame) -> DataFrame:
    """For looking at: the candidates of each end in order, (ctg1, end1, rank, ctg2, end2, w, zone1, zone2)."""
    return ranking.select("ctg1", "end1", "rank", "ctg2", "end2", "w", "zone1", "zone2")


def pair_table(cell_rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """For looking at: counted cells of pairs of contigs by name, (ctg1, ctg2, density: hits for each base of the second, mm, mp, pm, pp, len2)."""
    side = lambda i, *more: contigs.select(F.col("tid").alias(f"tid{i}"), F.col("name").alias(f"ctg{i}"), *more)
    named = cell_rows.join(side(1), "tid1").join(side(2, F.col("len").alias("len2")), "tid2")
    density = (F.col("mm") + F.col("mp") + F.col("pm") + F.col("pp")) / F.col("len2")
    return named.select("ctg1", "ctg2", density.alias("density"), "mm", "mp", "pm", "pp", "len2")
