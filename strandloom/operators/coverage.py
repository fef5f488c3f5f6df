"""Coverage by spans, its figures over regions, and the tracks made of it.

Positions count from 1 and intervals include both ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import settled

#: Regions of support with less than this between them are one.
JOIN_DISTANCE = 20
#: Width of the bins by which intervals meet regions.
REGION_BIN = 1 << 16
#: Width of the stretches of a scaffold that are swept by tasks of their own.
SWEEP_BIN = 1 << 20


def coverage(spans: DataFrame, scaffolds: DataFrame, width: int = SWEEP_BIN) -> DataFrame:
    """(scf, s, e, cov): intervals of equal coverage that tile 1 to len of every scaffold (scf, len).

    A sweep: each span (scf, s, e) adds 1 from s on and takes it back behind e; changes at one
    place are summed first.  The running sum is taken inside bins of positions, and the bins'
    own sums, a short row for each, are summed along the scaffold: no task holds a scaffold.
    """
    change = lambda place, by: F.struct(place.alias("pos"), F.lit(by).cast("long").alias("delta"))
    events = spans.select("scf", F.inline(F.array(change(F.col("s"), 1), change(F.col("e") + 1, -1))))
    events = events.unionByName(scaffolds.select("scf", F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("delta")))
    places = settled(events.groupBy("scf", "pos").agg(F.sum("delta").alias("delta")).withColumn("bin", F.floor(F.col("pos") / width)))  # read for the bins and for the sweep
    over = Window.partitionBy("scf").orderBy("bin")
    bins = places.groupBy("scf", "bin").agg(F.sum("delta").alias("change"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("change").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("scf", "bin", before.alias("before"), F.lead("first").over(over).alias("following")).join(scaffolds.select("scf", "len"), "scf")
    along = Window.partitionBy("scf", "bin").orderBy("pos")
    end = F.coalesce(F.coalesce(F.lead("pos").over(along), F.col("following")) - 1, F.col("len"))
    swept = places.join(bins, ["scf", "bin"]).withColumn("cov", F.col("before") + F.sum("delta").over(along)).withColumn("e", end)
    return swept.filter((F.col("pos") <= F.col("len")) & (F.col("e") >= F.col("pos"))).select("scf", F.col("pos").alias("s"), F.least("e", "len").alias("e"), "cov")


def overlaps(intervals: DataFrame, regions: DataFrame, width: int = REGION_BIN) -> DataFrame:
    """regions (scf, ..., rs, re) with the intervals that touch them, by bins of positions.

    Both sides are dealt to bins, and each pair is kept in the bin where its overlap begins.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width))).alias("bin")
    left = regions.select("*", bins(F.col("rs"), F.col("re")))
    right = intervals.select("*", bins(F.col("s"), F.col("e")))
    met = left.join(right, ["scf", "bin"]).filter((F.col("s") <= F.col("re")) & (F.col("e") >= F.col("rs")))
    return met.filter(F.floor(F.greatest("s", "rs") / width) == F.col("bin")).drop("bin")


def region_stats(intervals: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (scf, region, rs, re) with the maximum, mean and sample deviation of the coverage of their bases."""
    bases = (F.least("e", "re") - F.greatest("s", "rs") + 1).cast("double")
    met = overlaps(intervals, regions).withColumn("bases", bases)
    cov = F.col("cov").cast("double")
    summed = met.groupBy("scf", "region", "rs", "re").agg(F.max(cov).alias("max_cov"), F.sum(F.col("bases") * cov).alias("x"), F.sum(F.col("bases") * cov * cov).alias("xx"))
    n = (F.col("re") - F.col("rs") + 1).cast("double")
    spread = F.try_divide(F.col("xx"), n - 1) - F.try_divide(F.col("x") * F.col("x") / n, n - 1)
    return summed.select("scf", "region", "rs", "re", "max_cov", (F.col("x") / n).alias("mean_cov"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sd_cov"))


def _windows(intervals: DataFrame, width: int) -> DataFrame:
    """Intervals cut at multiples of width: (scf, window, s, e, cov)."""
    window = F.explode(F.sequence(F.floor((F.col("s") - 1) / width), F.floor((F.col("e") - 1) / width)))
    cut = intervals.withColumn("window", window)
    return cut.select("scf", "window", F.greatest(F.col("s"), F.col("window") * width + 1).alias("s"), F.least(F.col("e"), (F.col("window") + 1) * width).alias("e"), "cov")


def wig_windows(intervals: DataFrame, scaffolds: DataFrame, width: int = 1024) -> DataFrame:
    """(scf, start, span, cov): whole mean coverage in windows; the last two windows are one.

    A scaffold of at most two windows is one as a whole.
    """
    count = F.ceil(F.col("len") / width)
    last = F.greatest(count - 2, F.lit(0))
    joined = _windows(intervals, width).join(scaffolds.select("scf", "len"), "scf")
    at = joined.withColumn("at", F.least("window", last)).groupBy("scf", "len", "at").agg(F.sum((F.col("e") - F.col("s") + 1) * F.col("cov")).alias("total"))
    span = F.when(F.col("at") == last, F.col("len") - last * width).otherwise(F.lit(width))
    return at.select("scf", (F.col("at") * width + 1).alias("start"), span.cast("long").alias("span"), F.floor(F.col("total") / span).alias("cov"))


def histogram(intervals: DataFrame, most: int) -> DataFrame:
    """(cov, bases) for each coverage from 0 to ``most``, which stands for more too."""
    counted = intervals.groupBy(F.least(F.col("cov"), F.lit(most)).cast("long").alias("cov")).agg(F.sum(F.col("e") - F.col("s") + 1).alias("bases"))
    every = intervals.sparkSession.range(most + 1).select(F.col("id").alias("cov"))
    return every.join(counted, "cov", "left").select("cov", F.coalesce("bases", F.lit(0)).alias("bases"))


def column_maxima(intervals: DataFrame, width: int, columns: int) -> DataFrame:
    """(scf, window, col, max_cov): the largest coverage in each of the columns of each window, where positions count from 0."""
    narrow = width // columns
    cut = _windows(intervals, narrow).groupBy("scf", F.col("window").alias("narrow")).agg(F.max("cov").alias("max_cov"))
    return cut.select("scf", F.floor(F.col("narrow") / columns).alias("window"), (F.col("narrow") % columns).alias("col"), "max_cov")


def supported(intervals: DataFrame, low: int, high: int, distance: int = JOIN_DISTANCE, width: int = SWEEP_BIN) -> DataFrame:
    """(scf, s, e): intervals with coverage from low to high, joined where less than ``distance`` lies between.

    Islands are numbered inside bins of positions, and go on from bin to bin by the bins' own counts.
    """
    kept = intervals.filter(F.col("cov").between(low, high)).select("scf", "s", "e", F.floor(F.col("s") / width).alias("bin"))
    along, over = Window.partitionBy("scf", "bin").orderBy("s"), Window.partitionBy("scf").orderBy("bin")
    marked = kept.withColumn("apart", F.col("s") - F.lag("e").over(along) >= distance)  # null for the first of a bin
    bins = marked.groupBy("scf", "bin").agg(F.min("s").alias("first"), F.max("e").alias("last"), F.count(F.when(F.col("apart"), 1)).alias("inside"))
    bins = bins.withColumn("begins", F.coalesce(F.col("first") - F.lag("last").over(over) >= distance, F.lit(True)).cast("int"))
    before = F.coalesce(F.sum(F.col("inside") + F.col("begins")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = bins.select("scf", "bin", (before + F.col("begins")).alias("number"))
    island = F.col("number") + F.count(F.when(F.col("apart"), 1)).over(along)
    found = marked.join(numbered, ["scf", "bin"]).withColumn("island", island)
    return found.groupBy("scf", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("scf", "s", "e")


def base_coverage(intervals: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """(scf, s, e, cov): intervals, and one of coverage 0 for a scaffold that has none."""
    missing = scaffolds.join(intervals.select("scf").distinct(), "scf", "left_anti")
    return intervals.select("scf", "s", "e", "cov").unionByName(missing.select("scf", F.lit(1).cast("long").alias("s"), F.col("len").alias("e"), F.lit(0).cast("long").alias("cov")))
