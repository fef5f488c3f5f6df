"""Command line: link, build, break, break-links, gets, scaffold, pairs-bed, maps, sizes, conflicts, convert-bam and agp-assembly.

    python -m strandloom.cli scaffold -o OUT -x contigs.fai [-r contigs.fa] reads.bam ...

The flags keep the letters of the tool this engine stands in for where both have them; results
are folders of part files, as Spark writes them.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contacts, coverage, iterate, metrics, pairs, sequences
from .plans import scaffolding
from .plans.scaffolding import Options
from .sources import agp, bam, fasta, sat, text, tracks


def _reads(spark: SparkSession, paths: list[str], contigs: DataFrame) -> DataFrame:
    """Alignments of several BAM files (or of folders of decoded Parquet), with contigs found by name."""
    frames = []
    for i, path in enumerate(paths):
        if path.endswith(".bam"):
            records, targets = bam.renumbered(bam.read_bam(spark, path, columns=",".join(bam.KEPT))), bam.read_bam(spark, path, kind="targets")
        else:
            records, targets = bam.from_parquet(spark, path), bam.from_parquet(spark, path, "targets")
        named = bam.by_name(records, targets, contigs)
        frames.append(named.select((F.col("file_id") + bam.FILES**2 * i).alias("file_id"), "rec_no", "qname", "flag", "tid", "pos0", "mapq", "cigar"))
    return pairs.from_records(reduce(DataFrame.unionByName, frames))


def _contigs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """From the graph if there is one, else from the index, else from the first BAM's header."""
    if getattr(args, "sat", None):
        named = sat.read_sat(spark, args.sat).sequences.select("name", "len").withColumn("offset", F.lit(0))
        return text.contigs(named)
    if getattr(args, "fai", None):
        return text.contigs(text.read_fai(spark, args.fai))
    first = args.bams[0]
    targets = bam.read_bam(spark, first, kind="targets") if first.endswith(".bam") else bam.from_parquet(spark, first, "targets")
    return targets.filter(F.col("file_id") == 0).select("tid", "name", "len", F.lit(False).alias("is_circ"))


def _graph(spark: SparkSession, args: argparse.Namespace, contigs: DataFrame) -> sat.ScaffoldGraph:
    return sat.read_sat(spark, args.sat) if getattr(args, "sat", None) else scaffolding.first_graph(contigs)


def _options(args: argparse.Namespace) -> Options:
    given = {k: v for k, v in vars(args).items() if k in Options.__dataclass_fields__ and v is not None}
    return Options(**given)


def link(spark: SparkSession, args: argparse.Namespace) -> None:
    known = _contigs(spark, args)
    accepted = pairs.accepted_pairs(_reads(spark, args.bams, known), args.min_mapq)
    text.write_links(scaffolding.link(accepted, known, _graph(spark, args, known), _options(args)), args.out)


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    graph = _graph(spark, args, _contigs(spark, args))
    sat.write_sat(scaffolding.build(graph, text.read_links(spark, args.links), _options(args)), args.out)


def break_links(spark: SparkSession, args: argparse.Namespace) -> None:
    known = _contigs(spark, args)
    found = scaffolding.break_by_neighbours(text.read_links(spark, args.links), known, _graph(spark, args, known), args.limit, args.level)
    sat.write_sat(found, args.out)


def break_(spark: SparkSession, args: argparse.Namespace) -> None:
    known = _contigs(spark, args)
    accepted = pairs.accepted_pairs(_reads(spark, args.bams, known), args.min_mapq)
    found = scaffolding.break_misjoins(accepted, known, _graph(spark, args, known), _options(args))
    sat.write_sat(found.graph, f"{args.out}/{args.prefix}.sat")
    tracks.write_wig(coverage.wig_windows(found.intervals, found.scaffolds), f"{args.out}/HIC.cov.wig", "HIC")


def gets(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.pieces:
        fasta.write_pieces(sequences.sequence_pieces(scaffolding.current_placement(sat.read_sat(spark, args.sat)), fasta.read_fasta(spark, args.fasta)), args.out)
        return
    found = scaffolding.get_sequences(sat.read_sat(spark, args.sat), fasta.read_fasta(spark, args.fasta), args.min_length)
    fasta.write_fasta(found.select(F.col("scf").alias("name"), "seq"), args.out)


def scaffold(spark: SparkSession, args: argparse.Namespace) -> None:
    known = _contigs(spark, args)
    graph, broken = scaffolding.scaffold(_reads(spark, args.bams, known), known, _options(args))
    sat.write_sat(graph, f"{args.out}/scaffolds.sat")
    if broken:
        tracks.write_wig(coverage.wig_windows(broken.intervals, broken.scaffolds), f"{args.out}/HIC.cov.wig", "HIC")
    if args.fasta:
        found = scaffolding.get_sequences(graph, fasta.read_fasta(spark, args.fasta), args.min_length)
        fasta.write_fasta(found.select(F.col("scf").alias("name"), "seq"), f"{args.out}/scaffolds_final.fa")
    metrics.assembly_metrics(graph.current_sizes()).show()


def pairs_bed(spark: SparkSession, args: argparse.Namespace) -> None:
    known = _contigs(spark, args)
    accepted = pairs.accepted_pairs(_reads(spark, args.bams, known), args.min_mapq)
    lifted, placed = scaffolding.placed_pairs(accepted, known, _graph(spark, args, known))
    tracks.write_bed(pairs.pair_bed(lifted), f"{args.out}/pairs.bed")
    tracks.write_sizes(placed.groupBy(F.col("scf").alias("name")).agg(F.sum("len").alias("len")), f"{args.out}/chrom.sizes")
    contacts.binned(lifted).write.mode("overwrite").parquet(f"{args.out}/bins_1000.parquet")


def maps(spark: SparkSession, args: argparse.Namespace) -> None:
    """Bins at all zooms, and the map of all scaffolds on one axis at its widths, in Parquet by level and by width."""
    known = _contigs(spark, args)
    accepted = pairs.accepted_pairs(_reads(spark, args.bams, known), args.min_mapq)
    lifted, placed = scaffolding.placed_pairs(accepted, known, _graph(spark, args, known))
    lifted = iterate.settled(lifted)
    whole = placed.filter("is_tail").select("scf", (F.col("off") + F.col("len")).alias("len"))
    contacts.zoom_pyramid(lifted, whole).write.mode("overwrite").partitionBy("level").parquet(f"{args.out}/zooms.parquet")
    bases = iterate.settled(placed.groupBy("scf").agg(F.sum("len").alias("len")))
    scale = contacts.axis_scale(bases)
    contacts.axis_map(lifted, bases, scale).write.mode("overwrite").partitionBy("width").parquet(f"{args.out}/axis.parquet")
    tracks.write_sizes(contacts.axis_sizes(bases, scale), f"{args.out}/assembly.sizes")


def conflicts(spark: SparkSession, args: argparse.Namespace) -> None:
    """Lines of a graph that another line of their name leaves without effect."""
    found = sat.conflicts(spark, args.sat)
    found.select(F.concat_ws("\t", F.lit("ignored"), "ignored").alias("value")).write.mode("overwrite").text(args.out)


def sizes(spark: SparkSession, args: argparse.Namespace) -> None:
    tracks.write_sizes(sat.read_sat(spark, args.sat).current_sizes(), args.out)


def convert_bam(spark: SparkSession, args: argparse.Namespace) -> None:
    bam.to_parquet(spark, args.bams, args.out)


def agp_assembly(spark: SparkSession, args: argparse.Namespace) -> None:
    agp.write_assembly(agp.read_agp(spark, args.agp), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *groups: str) -> argparse.ArgumentParser:  # noqa: ANN001
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        one.add_argument("-o", dest="out", required=True)
        if "sat" in groups:
            one.add_argument("-s", dest="sat", help="scaffold graph")
        if "reads" in groups:
            one.add_argument("-q", dest="min_mapq", type=int, default=10, help="mapping quality of both reads")
            one.add_argument("bams", nargs="+")
        if "fai" in groups:
            one.add_argument("-x", dest="fai", help="index of the contigs")
        if "contacts" in groups:
            one.add_argument("--use-middle", dest="ignore_middle", action="store_false", help="ends are halves, not thirds")
            one.add_argument("--by-distance", dest="by_distance", action="store_true")
            one.add_argument("-a", "--all-contacts", dest="all_contacts", action="store_true")
        if "joins" in groups:
            one.add_argument("-w", dest="min_weight", type=float, help="hits that a link must exceed")
            one.add_argument("-k", dest="candidates", type=int, help="candidates of an end; -1: all that reach -w")
            one.add_argument("-p", dest="product", action="store_true", help="normalise by the product of the lengths")
            one.add_argument("-1", dest="spanning_forest", action="store_true")
            one.add_argument("--by-contig", dest="by_contig", action="store_true", help="pick candidates by contig, then orient")
            one.add_argument("--accurate", dest="accurate", action="store_true")
            one.add_argument("-f", dest="significance", type=float)
        if "break" in groups:
            one.add_argument("-m", dest="break_ratio", type=float, help="largest share of the neighbours' coverage at a cut")
        return one

    command("link", link, "sat", "fai", "contacts", "reads")
    command("build", build, "sat", "fai", "joins").add_argument("links")
    command("break", break_, "sat", "break", "reads").add_argument("-P", dest="prefix", default="scaffs.bk")
    one = command("break-links", break_links, "sat", "fai")
    one.add_argument("-n", dest="limit", type=int, default=2, help="a neighbour is among the first n - 1 by contacts")
    one.add_argument("-c", dest="level", type=float, help="judge by the order of contacts instead, at this level")
    one.add_argument("links")
    one = command("gets", gets, "sat")
    one.add_argument("-c", dest="fasta", required=True)
    one.add_argument("-l", dest="min_length", type=int, default=0)
    one.add_argument("--pieces", action="store_true", help="for scaffolds too long for one value: contigs in order, in lines of their own")
    one = command("scaffold", scaffold, "sat", "fai", "contacts", "joins", "break", "reads")
    one.add_argument("-i", dest="rounds", type=int)
    one.add_argument("-b", dest="break_misjoins", action="store_false", help="leave mis-joins")
    one.add_argument("-r", dest="fasta")
    one.add_argument("-l", dest="min_length", type=int, default=0)
    command("pairs-bed", pairs_bed, "sat", "fai", "reads")
    command("maps", maps, "sat", "fai", "reads")
    command("sizes", sizes, "sat")
    command("conflicts", conflicts, "sat")
    command("convert-bam", convert_bam, "reads")
    command("agp-assembly", agp_assembly).add_argument("agp")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    scaffolding.settings(spark)
    try:
        args.run(spark, args)
    finally:
        iterate.clear(spark)


if __name__ == "__main__":
    main()
