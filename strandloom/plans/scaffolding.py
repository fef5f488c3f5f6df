"""The scaffolding pipelines: link, build, break, get sequences, and the iteration of them.

Accepted read pairs do not depend on scaffolds, so they are computed once and every round and
the final break reuse them.  A round's paths are taken apart to contigs before the next
one places pairs on them, and are themselves the sequences that the next round joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import lift
from ..operators import breaks, candidates, chains, contacts, coverage, forest, matching, molecules, pairs, sequences, weights
from ..operators.iterate import running, settled
from ..sources.sat import ScaffoldGraph


@dataclass(frozen=True)
class Options:
    """Parameters of a run; the defaults are those of the iterative command."""

    min_mapq: int = 10
    rounds: int = 3
    min_weight: float = 100
    candidates: int = 3
    ignore_middle: bool = True
    product: bool = False
    by_contig: bool = False
    spanning_forest: bool = False
    accurate: bool = False
    significance: float = 0.95
    by_distance: bool = False
    all_contacts: bool = False
    break_ratio: float = 0.3
    break_misjoins: bool = True
    min_length: int = 0


def first_graph(contigs: DataFrame) -> ScaffoldGraph:
    """Contigs (name, len) as a graph of which each is a path of its own."""
    spark = contigs.sparkSession
    seqs = contigs.select("name", "len", F.lit(None).cast("string").alias("seq"))
    empty = lambda schema: spark.createDataFrame([], schema)
    return ScaffoldGraph(
        seqs, empty("v string, v_end string, w string, w_end string, wt double"),
        empty("name string, len bigint, is_circ boolean, elems array<struct<name: string, fwd: boolean>>"),
        empty("name string, place long, path string"), empty("name string"),
    )


def current_sequences(graph: ScaffoldGraph) -> DataFrame:
    """(name, len, is_circ) of what the next round joins: the current assembly's paths, or all sequences if there is none."""
    held = graph.current_paths().select(F.col("path").alias("name"))
    paths = graph.paths.join(held, "name", "left_semi").select("name", "len", "is_circ")
    if graph.current.limit(1).count():
        return paths
    return graph.sequences.select("name", "len", F.lit(False).alias("is_circ"))


def current_placement(graph: ScaffoldGraph) -> DataFrame:
    """(scf, ord, name, fwd, len, off, is_head, is_tail): contigs on the current assembly's paths, nested ones taken apart."""
    if graph.current.limit(1).count():
        flat = chains.flattened(graph.elements(), graph.current_paths().select(F.col("path").alias("root")))
        elements = flat.select(F.col("root").alias("scf"), "ord", "name", "fwd")
    else:
        elements = graph.sequences.select(F.col("name").alias("scf"), F.lit(1).alias("ord"), "name", F.lit(True).alias("fwd"))
    return chains.placements(elements.join(graph.sequences.select("name", "len"), "name"), "scf")


def placed_pairs(accepted: DataFrame, contigs: DataFrame, graph: ScaffoldGraph) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs lifted to the graph's scaffolds, and the placement with tid of contigs (tid, name)."""
    placed = settled(current_placement(graph).join(contigs.select("name", "tid"), "name"))
    return pairs.lifted_pairs(accepted, placed), placed


def link(accepted: DataFrame, contigs: DataFrame, graph: ScaffoldGraph, options: Options) -> DataFrame:
    """The contact matrix between the graph's current sequences, by name."""
    lifted, _ = placed_pairs(accepted, contigs, graph)
    onto = current_sequences(graph).select(F.col("name").alias("tid"), "name", "len", "is_circ")
    side = lambda i: [F.col(f"s{i}").alias(f"t{i}"), f"p{i}", f"r{i}"]
    hits = pairs.distinct_hits(lifted.select(*side(1), *side(2)), options.all_contacts)
    return contacts.named(contacts.contact_matrix(hits, onto, options.ignore_middle, options.by_distance), onto)


def joins_of(links: DataFrame, contigs: DataFrame, options: Options) -> DataFrame:
    """Directed joins, at most one for each end, by the chosen way of picking candidates."""
    if options.by_contig:
        rows = weights.cells(links, contigs, options.ignore_middle, options.product, options.min_weight)
        chosen = candidates.mutual_contigs(weights.top(weights.ranked_contigs(rows), options.candidates))
        edges = forest.contig_forest(chosen) if options.spanning_forest else candidates.oriented(chosen, options.significance if options.accurate else None)
    else:
        ranking = weights.ranked(weights.weigh(links, contigs, options.ignore_middle, options.product, options.min_weight))
        if options.accurate:
            ranking = weights.significant(ranking, options.significance)
        best = weights.over_count(ranking, options.min_weight) if options.candidates < 0 else weights.top(ranking, options.candidates)
        mutual = candidates.mutual(best).select("ctg1", "end1", "ctg2", "end2", "w")
        edges = forest.end_forest(mutual) if options.spanning_forest else mutual
    return matching.unique_best(edges)


def build(graph: ScaffoldGraph, links: DataFrame, options: Options) -> ScaffoldGraph:
    """The graph with a new assembly of paths over its current sequences.  Raises if links name others."""
    known = settled(current_sequences(graph))
    stray = weights.unknown_contigs(links, known).limit(3).collect()
    if stray:
        raise ValueError(f"links name unknown sequences: {', '.join(r['name'] for r in stray)}")
    joins = settled(joins_of(links, known, options))
    made = chains.paths_of(chains.scaffold_elements(joins, known))
    taken = graph.paths.select("name").unionByName(graph.sequences.select("name"))
    named = settled(chains.named_paths(made, taken).select("name", "len", "is_circ", "elems"))
    return with_assembly(
        replace(graph, joins=graph.joins.unionByName(joins.select(F.col("ctg1").alias("v"), F.col("end1").alias("v_end"), F.col("ctg2").alias("w"), F.col("end2").alias("w_end"), F.col("w").alias("wt"))), paths=graph.paths.unionByName(named)),
        named.select("name"),
    )


def with_assembly(graph: ScaffoldGraph, names: DataFrame) -> ScaffoldGraph:
    """The graph with an assembly of these paths, in order of name, the new current one; its own name is the next free number."""
    used = {r["name"] for r in graph.assemblies.select("name").distinct().collect()}  # one for each round
    n = len(used)
    while f"a{n:05d}" in used:
        n += 1
    placed = running(names.select(F.col("name").alias("path")), [F.col("path")], F.lit(1))
    made = placed.select(F.lit(f"a{n:05d}").alias("name"), F.col("before").alias("place"), "path")
    current = graph.sequences.sparkSession.createDataFrame([(f"a{n:05d}",)], "name string")
    return replace(graph, assemblies=graph.assemblies.unionByName(made), current=current)


@dataclass(frozen=True)
class Broken:
    graph: ScaffoldGraph
    intervals: DataFrame
    scaffolds: DataFrame
    stats: DataFrame
    calls: DataFrame


def break_misjoins(accepted: DataFrame, contigs: DataFrame, graph: ScaffoldGraph, options: Options) -> Broken:
    """Cuts paths where hardly any span crosses a gap; the pieces are a new assembly of flat paths."""
    lifted, placed = placed_pairs(accepted, contigs, graph)
    scaffolds = placed.filter("is_tail").select("scf", (F.col("off") + F.col("len")).alias("len"))
    spans = pairs.adjacent_spans(lifted).select("scf", F.col("pos1").alias("s"), F.col("pos2").alias("e"))
    return _cut(spans, placed, scaffolds, graph, options.break_ratio)


def break_by_molecules(hits: DataFrame, contigs: DataFrame, graph: ScaffoldGraph, ratio: float = 0.2, **molecule_options: int) -> Broken:
    """The same by molecules of linked reads: hits (bc, scf: tid of a contig, pos, mapq), contigs (tid, name)."""
    placed = settled(current_placement(graph).join(contigs.select("name", "tid"), "name"))
    scaffolds = placed.filter("is_tail").select("scf", (F.col("off") + F.col("len")).alias("len"))
    at = placed.select("tid", F.col("scf").alias("on"), "fwd", "off", "len")
    lifted = hits.join(at, F.col("scf") == F.col("tid")).select("bc", F.col("on").alias("scf"), lift(F.col("pos"), F.col("off"), F.col("fwd"), F.col("len")).alias("pos"), "mapq")
    spans = molecules.merged_starts(molecules.molecules(lifted, **molecule_options))
    return _cut(spans, placed, scaffolds, graph, ratio)


def break_by_neighbours(links: DataFrame, contigs: DataFrame, graph: ScaffoldGraph, limit: int = 2, level: float | None = None) -> ScaffoldGraph:
    """Cuts paths by the links between contigs alone: links (ctg1, end1, ctg2, end2, weight), contigs (tid, name, len).

    Behind elements whose neighbour is not among the first ``limit`` - 1 by contacts; with ``level`` by the
    order of the contacts of either end instead (see operators.breaks.misplacements).
    """
    placed = settled(current_placement(graph).join(contigs.select("name", "tid"), "name"))
    rows = settled(weights.counted_cells(links, contigs))
    if level is not None:
        cuts = breaks.misplacements(rows, placed, level)
    else:
        hits = rows.select("tid1", "tid2", (F.col("mm") + F.col("mp") + F.col("pm") + F.col("pp")).alias("hits"))
        true = settled(breaks.true_ranks(breaks.neighbour_ranks(hits, placed), placed))
        cuts = breaks.missing_neighbours(true, limit)
    return _pieces(settled(cuts), placed, graph)


def joins_by_barcodes(links: DataFrame, k: int = 1, level: float = 0.95) -> DataFrame:
    """Joins of a link matrix of shared barcodes: normalised by zone, mutual, and clearly the best at both ends, in candidates and in joins."""
    ranking = weights.ranked(weights.end_normalised(links))
    mutual = candidates.mutual(weights.top(weights.significant(ranking, level), k))
    return matching.unique_best(mutual.select("ctg1", "end1", "ctg2", "end2", "w", "weight"), level, hits="weight")


def _cut(spans: DataFrame, placed: DataFrame, scaffolds: DataFrame, graph: ScaffoldGraph, ratio: float) -> Broken:
    intervals = settled(coverage.coverage(spans, scaffolds))
    stats = settled(coverage.region_stats(intervals, breaks.regions(placed)))
    calls = settled(breaks.break_calls(stats, ratio))

    return Broken(_pieces(calls, placed, graph), intervals, scaffolds, stats, calls)


def _pieces(calls: DataFrame, placed: DataFrame, graph: ScaffoldGraph) -> ScaffoldGraph:
    """The graph with paths cut behind the elements in calls (scf, ord); all pieces are the new current assembly."""
    before = Window.partitionBy("scf").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.join(calls.select("scf", "ord", F.lit(1).alias("cut")), ["scf", "ord"], "left")
    cut = cut.withColumn("piece", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    circular = graph.paths.select(F.col("name").alias("scf"), "is_circ")
    elements = cut.join(circular, "scf", "left").select(F.concat("scf", F.lit("\x01"), F.format_string("%09d", "piece")).alias("head"), "scf", "piece", "ord", "name", "fwd", "len", F.coalesce("is_circ", F.lit(False)).alias("circ"))
    whole = elements.groupBy("scf").agg(F.max("piece").alias("last")).select("scf", (F.col("last") == 0).alias("uncut"))
    elements = elements.join(whole, "scf").withColumn("is_circ", F.col("circ") & F.col("uncut"))
    pieces_ = chains.paths_of(elements)
    first = pieces_.filter(F.right("head", F.lit(9)) == "000000000").withColumn("name", F.substring_index("head", "\x01", 1))
    taken = graph.paths.select("name").unionByName(graph.sequences.select("name"))
    later = chains.named_paths(pieces_.filter(F.right("head", F.lit(9)) != "000000000"), taken)
    columns = ["name", "len", "is_circ", "elems"]
    pieces_ = settled(first.select(*columns).unionByName(later.select(*columns)))
    others = graph.paths.join(pieces_.select("name"), "name", "left_anti")
    return with_assembly(replace(graph, paths=others.select(*columns).unionByName(pieces_)), pieces_.select("name"))


def get_sequences(graph: ScaffoldGraph, fasta: DataFrame, min_length: int = 0) -> DataFrame:
    """(scf, len, seq) of the current assembly."""
    return sequences.scaffold_sequences(current_placement(graph), fasta, min_length)


def scaffold(alignments: DataFrame, contigs: DataFrame, options: Options | None = None) -> tuple[ScaffoldGraph, Broken | None]:
    """All rounds and the break at the end: alignments as in operators.pairs, contigs (tid, name, len)."""
    options = options or Options()
    accepted = settled(pairs.accepted_pairs(alignments, options.min_mapq))
    graph = first_graph(contigs)
    for _ in range(options.rounds):
        graph = build(graph, settled(link(accepted, contigs, graph, options)), options)
    broken = break_misjoins(accepted, contigs, graph, options) if options.break_misjoins else None
    return (broken.graph if broken else graph), broken


def settings(spark: SparkSession) -> None:
    """What the engine expects of a session: plans that adapt, and ratios guarded instead of infinite."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
