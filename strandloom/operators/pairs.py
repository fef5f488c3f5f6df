"""From alignments to accepted read pairs and distinct hits.

Alignments: (file_id, rec_no, qname, is_r1, mapped, five, tid, pos, mapq, rev), pos from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import FIRST_READ, REVERSE, UNMAPPED, five_prime, has_flag, lift


def from_records(records: DataFrame) -> DataFrame:
    """Alignments from records of the file: (file_id, rec_no, qname, flag, tid, pos0, mapq, cigar)."""
    reverse = has_flag(F.col("flag"), REVERSE)
    op = lambda at: F.when(F.size("cigar") > 0, F.element_at("cigar", at)["op"])
    return records.select(
        "file_id", "rec_no", "qname",
        has_flag(F.col("flag"), FIRST_READ).alias("is_r1"), (~has_flag(F.col("flag"), UNMAPPED)).alias("mapped"),
        F.coalesce(five_prime(reverse, op(1), op(-1)), F.lit(False)).alias("five"),
        "tid", (F.col("pos0") + 1).cast("long").alias("pos"), F.col("mapq").cast("int").alias("mapq"), reverse.alias("rev"),
    )


def with_runs(alignments: DataFrame) -> DataFrame:
    """Numbers the runs of equal query names in each file.

    Records of a run follow each other, so within a name the record number less the rank stays
    the same along a run.  The window is over one name, never over a file.
    """
    rank = F.row_number().over(Window.partitionBy("file_id", "qname").orderBy("rec_no"))
    return alignments.withColumn("run", F.col("rec_no") - rank)


def templates(alignments: DataFrame) -> DataFrame:
    """One row for each run: counts of records and of five-prime records of either read, and the latter themselves."""
    five = F.col("mapped") & F.col("five")
    first, second = F.col("is_r1"), ~F.col("is_r1")
    fields = ["tid", "pos", "rev", "mapq"]
    # where a read has just one five-prime record, the maxima of its fields are that record
    maxima = [F.max(F.when(of & five, F.col(c))).alias(f"{c}{i}") for i, of in ((1, first), (2, second)) for c in fields]
    read = lambda i: F.struct(*[F.col(f"{c}{i}").alias(c) for c in fields]).alias(f"read{i}")
    counts = ["rd1", "rd2", "rd1_5", "rd2_5"]
    return (
        with_runs(alignments)
        .groupBy("file_id", "qname", "run")
        .agg(
            F.count_if(first).alias("rd1"), F.count_if(second).alias("rd2"),
            F.count_if(first & five).alias("rd1_5"), F.count_if(second & five).alias("rd2_5"),
            *maxima,
        )
        .select("file_id", "qname", "run", *counts, read(1), read(2))
    )


def is_accepted() -> Column:
    """At most two records of either read, exactly one of each five-prime."""
    return (F.col("rd1") < 3) & (F.col("rd2") < 3) & (F.col("rd1_5") == 1) & (F.col("rd2_5") == 1)


def is_mapped_well(min_mapq: int) -> Column:
    return (F.col("read1.mapq") >= min_mapq) & (F.col("read2.mapq") >= min_mapq)


def accepted_pairs(alignments: DataFrame, min_mapq: int = 10) -> DataFrame:
    """(file_id, qname, t1, p1, r1, q1, t2, p2, r2, q2) of templates that pass the filters.

    They do not depend on scaffolds: compute them once and reuse them in every round.
    """
    found = templates(alignments).filter(is_accepted() & is_mapped_well(min_mapq))
    read = lambda i: [F.col(f"read{i}.{c}").alias(f"{a}{i}") for c, a in (("tid", "t"), ("pos", "p"), ("rev", "r"), ("mapq", "q"))]
    return found.select("file_id", "qname", *read(1), *read(2))


def pair_stats(alignments: DataFrame, min_mapq: int = 10, all_contacts: bool = False) -> DataFrame:
    """(templates, used, ratio)."""
    used = is_accepted() & is_mapped_well(min_mapq)
    if not all_contacts:
        used = used & (F.col("read1.tid") != F.col("read2.tid"))
    counted = templates(alignments).agg(F.count(F.lit(1)).alias("templates"), F.count_if(used).alias("used"))
    return counted.withColumn("ratio", F.try_divide(F.col("used").cast("double"), F.col("templates").cast("double")))


def lifted_pairs(pairs: DataFrame, placement: DataFrame) -> DataFrame:
    """Pairs on scaffolds: (qname, s1, p1, r1, ord1, q1, s2, ...) by placement (scf, tid, ord, fwd, off, len).

    A strand that runs against its scaffold is turned.  Contigs without a place drop out.
    """
    def side(i: int) -> DataFrame:
        return placement.select(F.col("tid").alias(f"t{i}"), F.col("scf").alias(f"s{i}"), F.col("ord").alias(f"ord{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("fwd", "off", "len")])

    joined = pairs.join(side(1), "t1").join(side(2), "t2")
    place = lambda i: [
        F.col(f"s{i}"), F.col(f"ord{i}"),
        lift(F.col(f"p{i}"), F.col(f"off{i}"), F.col(f"fwd{i}"), F.col(f"len{i}")).alias(f"p{i}"),
        (F.col(f"r{i}") != ~F.col(f"fwd{i}")).alias(f"r{i}"), F.col(f"q{i}"),
    ]
    return joined.select("qname", *place(1), *place(2))


def distinct_hits(pairs: DataFrame, all_contacts: bool = False) -> DataFrame:
    """(id1, pos1, rev1, id2, pos2, rev2) with id1 < id2, each once; within a sequence only with ``all_contacts``."""
    side = lambda i: F.struct(F.col(f"t{i}").alias("id"), F.col(f"p{i}").alias("pos"), F.col(f"r{i}").alias("rev"))
    kept = pairs if all_contacts else pairs.filter("t1 <> t2")
    ordered = F.col("t1") < F.col("t2")
    sides = kept.select(F.when(ordered, side(1)).otherwise(side(2)).alias("a"), F.when(ordered, side(2)).otherwise(side(1)).alias("b"))
    return sides.select(*[F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("id", "pos", "rev")]).distinct()


def adjacent_spans(lifted: DataFrame) -> DataFrame:
    """(scf, pos1, rev1, pos2, rev2), pos1 < pos2, of pairs on one scaffold whose contigs are the same or neighbours; each once."""
    near = lifted.filter((F.col("s1") == F.col("s2")) & (F.abs(F.col("ord1") - F.col("ord2")) <= 1))
    side = lambda i: F.struct(F.col(f"p{i}").alias("pos"), F.col(f"r{i}").alias("rev"))
    ordered = F.col("p1") < F.col("p2")
    sides = near.select(F.col("s1").alias("scf"), F.when(ordered, side(1)).otherwise(side(2)).alias("a"), F.when(ordered, side(2)).otherwise(side(1)).alias("b"))
    return sides.select("scf", F.col("a.pos").alias("pos1"), F.col("a.rev").alias("rev1"), F.col("b.pos").alias("pos2"), F.col("b.rev").alias("rev2")).distinct()


def pair_bed(lifted: DataFrame) -> DataFrame:
    """Two rows for each pair: (scf, s, e, read, mapq, strand)."""
    row = lambda i: F.struct(
        F.col(f"s{i}").alias("scf"), F.col(f"p{i}").alias("s"), (F.col(f"p{i}") + 100).alias("e"),
        F.concat(F.col("qname").cast("string"), F.lit(f"/{i}")).alias("read"), F.col(f"q{i}").alias("mapq"),
        F.when(F.col(f"r{i}"), "-").otherwise("+").alias("strand"),
    )
    return lifted.select(F.inline(F.array(row(1), row(2))))
