"""Mis-joins: where to cut a path, and the pieces after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import GAP, clearly_more


def regions(placed: DataFrame) -> DataFrame:
    """(scf, region, is_gap, rs, re): contigs and the gaps between them, in turn; placed: (scf, ord, len, off, is_tail)."""
    contig = F.struct((F.col("ord") * 2 - 1).alias("region"), F.lit(False).alias("is_gap"), (F.col("off") + 1).alias("rs"), (F.col("off") + F.col("len")).alias("re"))
    gap = F.struct((F.col("ord") * 2).alias("region"), F.lit(True).alias("is_gap"), (F.col("off") + F.col("len") + 1).alias("rs"), (F.col("off") + F.col("len") + GAP).alias("re"))
    return placed.select("scf", F.inline(F.when(F.col("is_tail"), F.array(contig)).otherwise(F.array(contig, gap))))


def break_calls(stats: DataFrame, max_ratio: float = 0.3) -> DataFrame:
    """(scf, ord, left_ratio, right_ratio): gaps whose largest coverage is at most this share of that of both neighbours.

    stats: (scf, region, max_cov) of contigs and gaps in turn.  A neighbour without coverage
    decides nothing.
    """
    along = Window.partitionBy("scf").orderBy("region")
    ratio = lambda f: F.try_divide(F.col("max_cov"), f("max_cov").over(along))
    seen = stats.withColumn("left_ratio", ratio(F.lag)).withColumn("right_ratio", ratio(F.lead))
    cut = seen.filter((F.col("region") % 2 == 0) & (F.col("left_ratio") <= max_ratio) & (F.col("right_ratio") <= max_ratio))
    return cut.select("scf", F.floor(F.col("region") / 2).cast("int").alias("ord"), "left_ratio", "right_ratio")


def pieces(elements: DataFrame, breaks: DataFrame) -> DataFrame:
    """(scf, piece, n, len, first, last): paths (scf, ord, name, len) cut behind the elements in breaks (scf, ord).

    Piece 0 keeps the path's name.
    """
    cuts = breaks.select("scf", "ord").distinct().withColumn("cut", F.lit(1))
    before = Window.partitionBy("scf").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = elements.join(cuts, ["scf", "ord"], "left").withColumn("piece", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    found = numbered.groupBy("scf", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"), F.min_by("name", "ord").alias("first"), F.max_by("name", "ord").alias("last"))
    return found.select("scf", "piece", "n", (F.col("bases") + GAP * (F.col("n") - 1)).alias("len"), "first", "last")


def neighbour_ranks(cell_rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Contigs of one scaffold as (scf, ord1, ord2, forward, rank): neighbours ahead and behind, ranked by contacts.

    cell_rows: (tid1, tid2, hits): all hits of a pair of contigs; placed: (scf, tid, ord, len).
    A pair weighs its hits by the second contig's length.
    """
    side = lambda i: placed.select(F.col("tid").alias(f"tid{i}"), F.col("scf").alias(f"scf{i}"), F.col("ord").alias(f"ord{i}"), F.col("len").alias(f"len{i}"))
    near = cell_rows.join(side(1), "tid1").join(side(2), "tid2").filter("scf1 = scf2 and tid1 <> tid2")
    weighed = near.select(F.col("scf1").alias("scf"), "ord1", "ord2", (F.col("ord2") > F.col("ord1")).alias("forward"), (F.col("hits").cast("double") / F.col("len2")).alias("w"))
    order = Window.partitionBy("scf", "ord1", "forward").orderBy(F.desc("w"), "ord2")
    return weighed.withColumn("rank", F.row_number().over(order)).select("scf", "ord1", "ord2", "forward", "rank")


def true_ranks(ranks: DataFrame, placed: DataFrame) -> DataFrame:
    """(scf, ord, forward, rank) of every contig that has a neighbour on that side; rank null if there is no contact."""
    sides = placed.select("scf", "ord", "is_head", "is_tail", F.explode(F.array(F.lit(True), F.lit(False))).alias("forward"))
    sides = sides.filter(F.when(F.col("forward"), ~F.col("is_tail")).otherwise(~F.col("is_head")))
    true = ranks.filter(F.col("ord2") - F.col("ord1") == F.when(F.col("forward"), 1).otherwise(-1))
    return sides.join(true.select("scf", F.col("ord1").alias("ord"), "forward", "rank"), ["scf", "ord", "forward"], "left").select("scf", "ord", "forward", "rank")


def rank_histogram(true: DataFrame, limit: int = 7) -> DataFrame:
    """(rank, n) for ranks 1 to limit; ``limit`` stands for later ones and for none."""
    counted = true.groupBy(F.least(F.coalesce("rank", F.lit(limit)), F.lit(limit)).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    every = true.sparkSession.range(1, limit + 1).select(F.col("id").alias("rank"))
    return every.join(counted, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))


def missing_neighbours(true: DataFrame, limit: int) -> DataFrame:
    """(scf, ord): cut behind these elements, as one side's neighbour is not among the first limit - 1 of the other."""
    lost = true.filter(F.col("rank").isNull() | (F.col("rank") >= limit))
    return lost.select("scf", F.when(F.col("forward"), F.col("ord")).otherwise(F.col("ord") - 1).alias("ord")).distinct()


def doubtful_orientations(cell_rows: DataFrame, placed: DataFrame, level: float = 0.95) -> DataFrame:
    """(scf, ord): cut behind elements whose contacts with the next one clearly favour another end than the one that faces it.

    cell_rows: (tid1, tid2, mm, mp, pm, pp) as raw counts.  The end of a forward contig that
    faces the next one is "-".
    """
    here = placed.select(F.col("tid").alias("tid1"), "scf", "ord", "fwd")
    there = placed.select(F.col("tid").alias("tid2"), F.col("scf").alias("scf2"), (F.col("ord") - 1).alias("ord2"))
    seen = cell_rows.join(here, "tid1").join(there, "tid2").filter("scf = scf2 and ord = ord2")
    minus, plus = F.col("mm") + F.col("mp"), F.col("pm") + F.col("pp")
    facing, away = F.when(F.col("fwd"), minus).otherwise(plus), F.when(F.col("fwd"), plus).otherwise(minus)
    return seen.filter((away > facing) & clearly_more(away, facing, level)).select("scf", "ord")


def misplacements(cell_rows: DataFrame, placed: DataFrame, level: float = 0.95) -> DataFrame:
    """(scf, ord): cut behind these elements, judged by the order of each contig's contacts within its scaffold.

    cell_rows: (tid1, tid2, mm, mp, pm, pp) as raw counts; placed: (scf, ord, tid, fwd, len, is_head, is_tail).
    Contacts are ranked by hits for each base of the other contig.  A contact ahead belongs to the
    contig's tail (the end that faces what follows) unless its head has clearly more hits of it; one behind
    belongs to the head unless the tail has.  The first contact of the tail ought to be the next element and the first of the head
    the one before.  Where it is another one and the hits are clear, the path is cut on that side; where
    they are not, the contact ranked next is asked, and the path is cut unless that is the neighbour,
    clearly.  It is cut too where an end has no contact, and where its first one lies on the wrong side.
    """
    own = placed.select(F.col("tid").alias("tid1"), "scf", "ord", "fwd")
    other = placed.select(F.col("tid").alias("tid2"), F.col("scf").alias("scf2"), F.col("ord").alias("ord2"), "len")
    minus, plus = F.col("mm") + F.col("mp"), F.col("pm") + F.col("pp")
    seen = cell_rows.filter("tid1 <> tid2").join(own, "tid1").join(other, "tid2").withColumns(
        {"tail": F.when(F.col("fwd"), minus).otherwise(plus), "head": F.when(F.col("fwd"), plus).otherwise(minus), "w": (minus + plus) / F.col("len")}
    )
    order = Window.partitionBy("tid1").orderBy(F.desc("w"), "tid2")
    seen = seen.withColumn("rank", F.row_number().over(order)).withColumn("after", F.lead(F.struct("scf2", "ord2", "tail", "head")).over(order))
    near = seen.filter("scf = scf2")
    ahead = F.col("ord2") > F.col("ord")
    tails = F.when(ahead, ~clearly_more(F.col("head"), F.col("tail"), level)).otherwise(clearly_more(F.col("tail"), F.col("head"), level))
    contact = F.struct("rank", "ord2", "tail", "head", "after")
    firsts = near.withColumn("of_tail", tails).groupBy("scf", "ord").agg(F.min(F.when(F.col("of_tail"), contact)).alias("t"), F.min(F.when(~F.col("of_tail"), contact)).alias("h"))
    judged = placed.select("scf", "ord", "is_head", "is_tail").join(firsts, ["scf", "ord"], "left")

    def cut(first: str, step: int, more: str, less: str) -> Column:
        neighbour, after = F.col("ord") + step, F.col(f"{first}.after")
        right_side = (F.col(f"{first}.ord2") > F.col("ord")) if step > 0 else (F.col(f"{first}.ord2") < F.col("ord"))
        clear = clearly_more(F.col(f"{first}.{more}"), F.col(f"{first}.{less}"), level)
        saved = (after["scf2"] == F.col("scf")) & (after["ord2"] == neighbour) & clearly_more(after[more], after[less], level)
        stays = right_side & ((F.col(f"{first}.ord2") == neighbour) | (~clear & F.coalesce(saved, F.lit(False))))
        return ~F.coalesce(stays, F.lit(False))

    behind = F.when(~F.col("is_tail") & cut("t", 1, "tail", "head"), F.col("ord"))
    before = F.when(~F.col("is_head") & cut("h", -1, "head", "tail"), F.col("ord") - 1)
    return judged.select("scf", F.explode(F.array_compact(F.array(behind, before))).alias("ord")).distinct()
