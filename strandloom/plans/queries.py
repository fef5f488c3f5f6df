"""The registered queries over a data folder, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import reverse_complement
from ..operators import breaks, candidates, chains, contacts, coverage, forest, matching, metrics, molecules, pairs, sequences, weights
from ..operators.iterate import shared_folder
from ..sources import agp, bam, fasta, sat, text, tracks
from . import scaffolding, views
from .views import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters for the small counts of these tables.
TOP, SIGNIFICANT, SHARE, CUT_RATIO = 3, 0.6, 0.3, 0.8
MOLECULES = {"max_span": 43_200, "min_barcode": 3, "min_members": 1, "min_mean_mapq": 5}


def query(oracle: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **ctes)
        return f

    return register


# pairs


@query("SELECT qname, rd1, rd2, rd1_5, rd2_5 FROM template")
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.templates(views.alignments(spark, sf_dir)).select("qname", "rd1", "rd2", "rd1_5", "rd2_5")


@query("SELECT qname, t1, p1, r1, q1, t2, p2, r2, q2 FROM pair")
def accepted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.accepted(spark, sf_dir).drop("file_id")


@query("""SELECT count(*) AS templates, (SELECT count(*) FROM pair WHERE t1 <> t2) AS used,
  (SELECT count(*) FROM pair WHERE t1 <> t2)::DOUBLE / count(*)::DOUBLE AS ratio FROM template""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_stats(views.alignments(spark, sf_dir))


@query("SELECT id1, pos1, rev1, id2, pos2, rev2 FROM hit")
def hits_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hits(spark, sf_dir)


@query("SELECT tid, is_r1, mapped, five, rev, count(*) AS n, sum(pos)::BIGINT AS pos, sum(mapq)::BIGINT AS mapq FROM record GROUP BY tid, is_r1, mapped, five, rev")
def records_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, and the base that a read begins with by its CIGAR."""
    found = pairs.from_records(views.records(spark, sf_dir))
    return found.groupBy("tid", "is_r1", "mapped", "five", "rev").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("mapq").alias("mapq"))


@query("SELECT right(qname, 16) AS bc, tid AS scf, count(*) AS n, min(pos) AS first, max(pos) AS last FROM record WHERE mapped AND is_r1 AND mapq >= 20 GROUP BY 1, 2")
def barcoded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped first reads of good quality, by the barcode at the end of their names."""
    found = molecules.barcode_hits(views.records(spark, sf_dir), min_mapq=20)
    return found.groupBy("bc", "scf").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


# contacts


@query("""SELECT id, zone, count(*) AS n FROM (
  SELECT id1 AS id, coalesce(end1, '.') AS zone FROM link_end UNION ALL SELECT id2, coalesce(end2, '.') FROM link_end) GROUP BY id, zone""")
def zone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.zone_counts(views.hits(spark, sf_dir), views.contigs(spark, sf_dir))


CELLS = "ctg1, end1, ctg2, end2, {}, zone2, zone1, n"


@query(f"SELECT {CELLS.format('weight')} FROM link")
def contact_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.links(spark, sf_dir)


@query(f"SELECT {CELLS.format('weight')} FROM link_half")
def contact_matrix_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.links(spark, sf_dir, ignore_middle=False)


@query(f"SELECT {CELLS.format('round(by_dist, 9) AS weight')} FROM link WHERE by_dist <> 0")
def contact_matrix_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.links(spark, sf_dir, by_distance=True).withColumn("weight", F.round("weight", 9))


@query(f"SELECT {CELLS.format('weight')} FROM link_all")
def contact_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.contigs(spark, sf_dir)
    return contacts.named(contacts.contact_matrix(views.hits(spark, sf_dir, all_contacts=True), known), known)


@query(f"SELECT {CELLS.format('weight')} FROM link WHERE ctg1 NOT IN (SELECT name FROM contig WHERE tid % 5 = 0) AND ctg2 NOT IN (SELECT name FROM contig WHERE tid % 5 = 0)")
def contact_matrix_without_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth contig is a circle, which has no ends to join."""
    known = views.contigs(spark, sf_dir).withColumn("is_circ", F.col("tid") % 5 == 0)
    return contacts.named(contacts.contact_matrix(views.hits(spark, sf_dir), known), known)


# weights and candidates


def _weighed(spark: SparkSession, sf_dir: str, product: bool = False) -> DataFrame:
    return weights.weigh(views.links(spark, sf_dir), views.contigs(spark, sf_dir), product=product)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.ranked(_weighed(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.cells(views.links(spark, sf_dir), views.contigs(spark, sf_dir))


def _mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.mutual(weights.top(_ranked(spark, sf_dir), TOP))


def _joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unique_best(_mutual(spark, sf_dir))


ENDS = ["ctg1", "end1", "ctg2", "end2"]


@query("SELECT ctg1, end1, ctg2, end2, w FROM weighed")
def link_weights_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir).select(*ENDS, "w")


@query("SELECT ctg1, end1, ctg2, end2, CASE WHEN weight > 2 THEN w ELSE 0.0 END AS w FROM weighed")
def link_weights_over_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weights.weigh(views.links(spark, sf_dir), views.contigs(spark, sf_dir), min_weight=2)
    return found.select(*ENDS, "w")


@query("SELECT ctg1, end1, ctg2, end2, w2 * 1e6 AS w FROM weighed")
def link_weights_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir, product=True).select(*ENDS, (F.col("w") * 1e6).alias("w"))


@query("SELECT ctg1, ctg2, mm, mp, pm, pp, best FROM cell")
def cells_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).drop("hits")


@query(f"SELECT ctg1, end1, ctg2, end2, w, rank::INT AS rank FROM ranked WHERE rank <= {TOP}")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.top(_ranked(spark, sf_dir), TOP).select(*ENDS, "w", "rank")


@query("SELECT ctg1, end1, ctg2, end2, weight FROM ranked WHERE weight >= 2")
def candidates_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.over_count(_ranked(spark, sf_dir), 2).select(*ENDS, "weight")


@query("""SELECT r.ctg1, r.end1, r.ctg2, r.end2, r.weight FROM ranked r LEFT JOIN ranked a ON a.ctg1 = r.ctg1 AND a.end1 = r.end1 AND a.rank = 1
  LEFT JOIN ranked b ON b.ctg1 = r.ctg1 AND b.end1 = r.end1 AND b.rank = 2
  WHERE r.rank = 1 AND (b.ctg2 IS NULL OR b.ctg2 = a.ctg2 OR (a.weight - (a.weight + b.weight) / 2) / sqrt((a.weight + b.weight) / 4) > 0.2533471031357997)""")
def significant_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.significant(_ranked(spark, sf_dir), SIGNIFICANT).filter("rank = 1").select(*ENDS, "weight")


@query("SELECT ctg1, end1, ctg2, end2, w FROM mutual")
def mutual_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutual(spark, sf_dir).select(*ENDS, "w")


@query("SELECT ctg1, ctg2, best FROM mutual_cell")
def mutual_contig_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.mutual_contigs(weights.top(weights.ranked_contigs(_cells(spark, sf_dir)), TOP)).select("ctg1", "ctg2", "best")


@query("""SELECT ctg1, ctg2, CASE WHEN (mm = best)::INT + (mp = best)::INT + (pm = best)::INT + (pp = best)::INT <> 1 THEN NULL
  WHEN mm = best THEN 0 WHEN mp = best THEN 1 WHEN pm = best THEN 2 ELSE 3 END::BIGINT AS cell FROM cell""")
def orientation_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.orientation(_cells(spark, sf_dir)).select("ctg1", "ctg2", F.col("cell").cast("long").alias("cell"))


@query("""SELECT ctg1, CASE WHEN greatest(pm, pp) = best THEN '+' ELSE '-' END AS end1, ctg2, CASE WHEN greatest(mp, pp) = best THEN '+' ELSE '-' END AS end2, best AS w
  FROM mutual_cell WHERE (mm = best)::INT + (mp = best)::INT + (pm = best)::INT + (pp = best)::INT = 1""")
def oriented_contig_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.oriented(candidates.mutual_contigs(weights.top(weights.ranked_contigs(_cells(spark, sf_dir)), TOP)))


@query("""SELECT ctg1, ctg2, CASE WHEN rank = 1 AND (hits - (hits + second) / 2) / sqrt((hits + second) / 4) > 0.2533471031357997
    THEN CASE WHEN mm = best THEN 0 WHEN mp = best THEN 1 WHEN pm = best THEN 2 ELSE 3 END END::BIGINT AS cell FROM (
  SELECT r.*, hits, list_sort([mm, mp, pm, pp])[3] / best * hits AS second FROM ranked_cell r JOIN (SELECT ctg1, ctg2, max(weight) AS hits FROM weighed WHERE w > 0 GROUP BY ctg1, ctg2) USING (ctg1, ctg2))""")
def orientation_accurate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates.orientation(weights.ranked_contigs(_cells(spark, sf_dir)), SIGNIFICANT)
    return found.select("ctg1", "ctg2", F.col("cell").cast("long").alias("cell"))


@query(
    "SELECT a.ctg1, a.end1, a.ctg2, a.end2, a.w FROM clear a JOIN clear b ON b.ctg1 = a.ctg2 AND b.end1 = a.end2 AND b.ctg2 = a.ctg1 AND b.end2 = a.end1",
    clear="""
  SELECT ctg1, end1, ctg2, end2, w FROM (
    SELECT *, row_number() OVER e AS place, lead(w) OVER e AS next_w, lead(weight) OVER e AS less FROM mutual WINDOW e AS (PARTITION BY ctg1, end1 ORDER BY w DESC, ctg2, end2))
  WHERE place = 1 AND (next_w IS NULL OR (next_w < w AND (weight - (weight + less) / 2) / sqrt((weight + less) / 4) > 0.2533471031357997))""",
)
def clear_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of ends whose best link has clearly more hits than the second."""
    return matching.unique_best(_mutual(spark, sf_dir).select(*ENDS, "w", "weight"), SIGNIFICANT, hits="weight")


@query("SELECT ctg1, end1, ctg2, end2, w FROM joined")
def unique_best_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joins(spark, sf_dir)


@query(f"""SELECT ctg1, end1, ctg2, end2, weight, share FROM (
  SELECT *, max(weight) OVER (PARTITION BY ctg1, end1) / sum(weight) OVER (PARTITION BY ctg1, end1) AS share FROM ranked WHERE rank <= {TOP}) WHERE share >= {SHARE}""")
def max_share_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.max_share(weights.top(_ranked(spark, sf_dir), TOP), SHARE).select(*ENDS, "weight", "share")


@query("SELECT ctg1, end1, ctg2, end2, CASE WHEN zone2 <> 0 THEN weight / zone2::DOUBLE ELSE 0.0 END AS w FROM link")
def end_normalised_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.end_normalised(views.links(spark, sf_dir)).select(*ENDS, "w")


@query("SELECT ctg1, end1, rank::INT AS rank, ctg2, end2, w, zone1, zone2 FROM ranked")
def candidates_of_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.end_table(_ranked(spark, sf_dir))


@query("""SELECT ctg1, ctg2, (mm + mp + pm + pp) / len2 AS density, mm, mp, pm, pp, len2 FROM (
  SELECT ctg1, ctg2, coalesce(sum(n) FILTER (end1 = '-' AND end2 = '-'), 0)::DOUBLE AS mm, coalesce(sum(n) FILTER (end1 = '-' AND end2 = '+'), 0)::DOUBLE AS mp,
         coalesce(sum(n) FILTER (end1 = '+' AND end2 = '-'), 0)::DOUBLE AS pm, coalesce(sum(n) FILTER (end1 = '+' AND end2 = '+'), 0)::DOUBLE AS pp, max(c.len) AS len2
  FROM link JOIN contig c ON c.name = ctg2 GROUP BY ctg1, ctg2)""")
def contacts_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.contigs(spark, sf_dir)
    return weights.pair_table(weights.counted_cells(views.links(spark, sf_dir), known), known)


# forests


def _mutual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.mutual_contigs(weights.top(weights.ranked_contigs(_cells(spark, sf_dir)), TOP))


#: An edge is in the forest if its ends are not connected by edges before it in the order of weight and names.
NUMBERED = "SELECT a, b, w, row_number() OVER (ORDER BY w DESC, a, b) AS k FROM ({})"
REACH = """
  SELECT k, a AS node FROM numbered
  UNION
  SELECT reach.k, CASE WHEN n.a = node THEN n.b ELSE n.a END FROM reach JOIN numbered n ON n.k < reach.k AND (n.a = node OR n.b = node)"""
FOREST = "SELECT a, b, w FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k = n.k AND r.node = n.b)"


@query("SELECT a, b, w FROM forest", numbered=NUMBERED.format("SELECT least(ctg1, ctg2) AS a, greatest(ctg1, ctg2) AS b, max(best) AS w FROM mutual_cell GROUP BY ALL"), reach=REACH, forest=FOREST)
def max_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.spanning_forest(_mutual_cells(spark, sf_dir).select(F.least("ctg1", "ctg2").alias("a"), F.greatest("ctg1", "ctg2").alias("b"), F.col("best").alias("w")))


@query("SELECT a, b, w FROM forest", numbered=NUMBERED.format("SELECT least(ctg1, ctg2) AS a, greatest(ctg1, ctg2) AS b, max(best) AS w FROM mutual_cell GROUP BY ALL"), reach=REACH, forest=FOREST)
def max_spanning_forest_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forest as a large graph's is found."""
    edges = _mutual_cells(spark, sf_dir).select(F.least("ctg1", "ctg2").alias("a"), F.greatest("ctg1", "ctg2").alias("b"), F.col("best").alias("w"))
    return forest.spanning_forest(edges, small=0)


ENDS_AND_INSIDES = """
  SELECT least(ctg1 || end1, ctg2 || end2) AS a, greatest(ctg1 || end1, ctg2 || end2) AS b, max(w) AS w FROM mutual GROUP BY ALL
  UNION ALL SELECT ctg1 || '+', ctg1 || '-', 'inf'::DOUBLE FROM (SELECT DISTINCT ctg1 FROM mutual)"""
BRANCHES = "SELECT node FROM (SELECT a AS node FROM forest UNION ALL SELECT b FROM forest) GROUP BY node HAVING count(*) > 2"
KEPT = "SELECT * FROM forest WHERE a NOT IN (FROM branch) AND b NOT IN (FROM branch) AND w < 'inf'::DOUBLE"


@query(
    """SELECT left(a, length(a) - 1) AS ctg1, right(a, 1) AS end1, left(b, length(b) - 1) AS ctg2, right(b, 1) AS end2, w * 1000000 AS w FROM kept
  UNION ALL SELECT left(b, length(b) - 1), right(b, 1), left(a, length(a) - 1), right(a, 1), w * 1000000 FROM kept""",
    numbered=NUMBERED.format(ENDS_AND_INSIDES), reach=REACH, forest=FOREST, branch=BRANCHES, kept=KEPT,
)
def end_forest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.end_forest(_mutual(spark, sf_dir).select(*ENDS, "w"))


@query(
    """SELECT left(a, length(a) - 1) AS ctg1, right(a, 1) AS end1, left(b, length(b) - 1) AS ctg2, right(b, 1) AS end2, w * 1000000 AS w FROM kept
  UNION ALL SELECT left(b, length(b) - 1), right(b, 1), left(a, length(a) - 1), right(a, 1), w * 1000000 FROM kept""",
    numbered=NUMBERED.format(ENDS_AND_INSIDES), reach=REACH, forest=FOREST, branch=BRANCHES, kept=KEPT,
)
def end_forest_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges as a large graph's are found."""
    return forest.end_forest(_mutual(spark, sf_dir).select(*ENDS, "w"), small=0)


#: Along the chains of a forest without branches: for either direction of the contig reached, the best sum and the directions on the way.
CHAIN = """
  SELECT x AS first, NULL::VARCHAR AS prev, x AS name, [x] AS names, 0.0::DOUBLE AS sf, 0.0::DOUBLE AS sb, [true] AS wf, [false] AS wb
  FROM near GROUP BY x HAVING count(*) = 1
  UNION ALL
  SELECT first, c.name, y, list_append(names, y), greatest(sf + mp, sb + pp), greatest(sf + mm, sb + pm),
         list_append(CASE WHEN sf + mp >= sb + pp THEN wf ELSE wb END, true), list_append(CASE WHEN sf + mm >= sb + pm THEN wf ELSE wb END, false)
  FROM chain c JOIN near ON x = c.name AND (prev IS NULL OR y <> prev) JOIN mutual_cell m ON m.ctg1 = c.name AND m.ctg2 = y"""
WAYS = """
  SELECT names, CASE WHEN sf >= sb THEN wf ELSE wb END AS way FROM chain WHERE len(names) > 1 AND first < name AND name IN (SELECT x FROM near GROUP BY x HAVING count(*) = 1)"""
STEPS = """
  SELECT ctg1, CASE WHEN f1 THEN '-' ELSE '+' END AS end1, ctg2, CASE WHEN f2 THEN '+' ELSE '-' END AS end2,
         CASE WHEN f1 AND f2 THEN mp WHEN f1 THEN mm WHEN f2 THEN pp ELSE pm END * 1000000 AS w
  FROM (SELECT names[i] AS ctg1, names[i + 1] AS ctg2, way[i] AS f1, way[i + 1] AS f2 FROM (SELECT *, unnest(range(1, len(names))) AS i FROM ways)) JOIN mutual_cell USING (ctg1, ctg2)"""
CONTIG_FOREST = {
    "numbered": NUMBERED.format("SELECT least(ctg1, ctg2) AS a, greatest(ctg1, ctg2) AS b, max(best) AS w FROM mutual_cell GROUP BY ALL"), "reach": REACH, "forest": FOREST, "branch": BRANCHES,
    "near": "SELECT a AS x, b AS y FROM forest WHERE a NOT IN (FROM branch) AND b NOT IN (FROM branch) UNION ALL SELECT b, a FROM forest WHERE a NOT IN (FROM branch) AND b NOT IN (FROM branch)",
    "chain": CHAIN, "ways": WAYS, "steps": STEPS,
}


@query("SELECT ctg1, end1, ctg2, end2, w FROM steps UNION ALL SELECT ctg2, end2, ctg1, end1, w FROM steps", **CONTIG_FOREST)
def contig_forest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.contig_forest(_mutual_cells(spark, sf_dir))


@query("SELECT ctg1, end1, ctg2, end2, w FROM steps UNION ALL SELECT ctg2, end2, ctg1, end1, w FROM steps", **CONTIG_FOREST)
def contig_forest_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.contig_forest(_mutual_cells(spark, sf_dir), small=0)


# paths

#: Walks from every free end, and along cycles from every contig; of the two directions one is chosen.
WALK = """
  SELECT name AS start, e AS start_end, name, e AS enter, 1 AS ord FROM contig, (VALUES ('+'), ('-')) v(e)
  WHERE NOT EXISTS (SELECT 1 FROM joined WHERE ctg1 = name AND end1 = e)
  UNION ALL
  SELECT start, start_end, ctg2, end2, ord + 1 FROM walk JOIN joined ON ctg1 = walk.name AND end1 <> enter"""
CYCLE = """
  SELECT name AS start, name, '+' AS enter, 1 AS ord FROM contig WHERE name NOT IN (SELECT name FROM walk)
  UNION ALL
  SELECT start, ctg2, end2, ord + 1 FROM cycle JOIN joined ON ctg1 = cycle.name AND end1 <> enter WHERE ctg2 <> start"""
CHOSEN = """
  SELECT w.start AS head, false AS is_circ, w.ord, w.name, w.enter = '+' AS fwd FROM walk w JOIN (
    SELECT start, start_end, max_by(name, ord) AS tail, count(*) AS n FROM walk GROUP BY start, start_end) t USING (start, start_end)
  WHERE CASE WHEN n = 1 THEN start_end = '+' ELSE start < tail END
  UNION ALL
  SELECT start, true, ord, name, enter = '+' FROM cycle WHERE start IN (SELECT start FROM cycle GROUP BY start HAVING min(name) = start)"""


@query("SELECT head, is_circ, ord, name, fwd FROM chosen", walk=WALK, cycle=CYCLE, chosen=CHOSEN)
def scaffold_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.scaffold_elements(_joins(spark, sf_dir), views.contigs(spark, sf_dir)).select("head", "is_circ", "ord", "name", "fwd")


@query("SELECT head, is_circ, ord, name, fwd FROM chosen", walk=WALK, cycle=CYCLE, chosen=CHOSEN)
def scaffold_paths_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths as a large graph's are found."""
    return chains.scaffold_elements(_joins(spark, sf_dir), views.contigs(spark, sf_dir), small=0).select("head", "is_circ", "ord", "name", "fwd")


@query(
    """SELECT (CASE WHEN is_circ THEN 'c' ELSE 'u' END) || lpad((row_number() OVER (ORDER BY head) - 1)::VARCHAR, 9, '0') AS name, len, is_circ, elems FROM (
  SELECT head, is_circ, (sum(len) + 200 * (count(*) - 1))::BIGINT AS len, string_agg(name || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY ord) AS elems
  FROM chosen JOIN contig USING (name) GROUP BY head, is_circ)""",
    walk=WALK, cycle=CYCLE, chosen=CHOSEN,
)
def named_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = chains.paths_of(chains.scaffold_elements(_joins(spark, sf_dir), views.contigs(spark, sf_dir)))
    elems = F.array_join(F.transform("elems", lambda x: F.concat(x["name"], F.when(x["fwd"], "+").otherwise("-"))), ",")
    return chains.named_paths(paths).select("name", "len", "is_circ", elems.alias("elems"))


#: Regions as paths of nations, and two paths made of regions, one turned.
NESTED = """
  SELECT 'r' || scf AS path, ord, name, fwd FROM element
  UNION ALL SELECT 'west', r_regionkey + 1, 'r' || r_regionkey, r_regionkey % 2 = 0 FROM region WHERE r_regionkey < 3
  UNION ALL SELECT 'world', 1, 'west', false UNION ALL SELECT 'world', r_regionkey, 'r' || r_regionkey, true FROM region WHERE r_regionkey >= 3"""
FLAT = """
  SELECT path AS root, [ord::BIGINT] AS key, name, fwd FROM nested WHERE path IN ('west', 'world')
  UNION ALL
  SELECT root, list_append(key, CASE WHEN flat.fwd THEN n.ord ELSE -n.ord END::BIGINT), n.name, flat.fwd = n.fwd FROM flat JOIN nested n ON n.path = flat.name"""


@query("SELECT root, (row_number() OVER (PARTITION BY root ORDER BY key))::INT AS ord, name, fwd FROM flat WHERE name NOT IN (SELECT path FROM nested)", nested=NESTED, flat=FLAT)
def path_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    of = F.concat(F.lit("r"), F.col("r").cast("string")).alias("name")
    inner = views.scaffold_elements(spark, sf_dir).select(F.concat(F.lit("r"), F.col("scf").cast("string")).alias("path"), "ord", "name", "fwd")
    west = region.filter("r < 3").select(F.lit("west").alias("path"), (F.col("r") + 1).alias("ord"), of, (F.col("r") % 2 == 0).alias("fwd"))
    world = region.filter("r >= 3").select(F.lit("world").alias("path"), F.col("r").alias("ord"), of, F.lit(True).alias("fwd"))
    first = spark.createDataFrame([("world", 1, "west", False)], "path string, ord int, name string, fwd boolean")
    roots = spark.createDataFrame([("west",), ("world",)], "root string")
    return chains.flattened(inner.unionByName(west).unionByName(world).unionByName(first), roots)


@query("SELECT scf, ord::INT AS ord, tid, fwd, off, len, is_head, is_tail FROM placed")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.placement(spark, sf_dir).select("scf", "ord", "tid", "fwd", "off", "len", "is_head", "is_tail")


@query("SELECT qname, s1, p1, r1, s2, p2, r2 FROM lifted")
def liftover_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lifted(spark, sf_dir).select("qname", "s1", "p1", "r1", "s2", "p2", "r2")


@query("SELECT scf, pos1, rev1, pos2, rev2 FROM span")
def adjacent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.adjacent_spans(views.lifted(spark, sf_dir))


# coverage and breaks


@query("SELECT scf, s, e, cov FROM cover")
def coverage_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.covered(spark, sf_dir)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.region_stats(views.covered(spark, sf_dir), breaks.regions(views.placement(spark, sf_dir)))


@query("SELECT scf, region::INT AS region, rs, re, max_cov, round(mean_cov, 6) AS mean_cov, round(sd_cov, 6) AS sd_cov FROM stat")
def region_coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stats(spark, sf_dir)
    return found.withColumn("mean_cov", F.round("mean_cov", 6)).withColumn("sd_cov", F.round("sd_cov", 6))


@query("SELECT scf, ord, left_ratio, right_ratio FROM cut")
def break_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.break_calls(_stats(spark, sf_dir), CUT_RATIO)


@query("""SELECT scf, piece, count(*) AS n, (sum(len) + 200 * (count(*) - 1))::BIGINT AS len, min_by(name, ord) AS first, max_by(name, ord) AS last FROM (
  SELECT e.scf, e.ord, e.name, e.len, count(c.ord) OVER (PARTITION BY e.scf ORDER BY e.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece
  FROM element e LEFT JOIN cut c ON c.scf = e.scf AND c.ord = e.ord) GROUP BY scf, piece""")
def path_pieces_after_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.pieces(views.scaffold_elements(spark, sf_dir), breaks.break_calls(_stats(spark, sf_dir), CUT_RATIO))


@query("""SELECT scf, (place * 1024 + 1)::BIGINT AS start, (CASE WHEN place = last THEN len - last * 1024 ELSE 1024 END)::BIGINT AS span, (total // (CASE WHEN place = last THEN len - last * 1024 ELSE 1024 END))::BIGINT AS cov FROM (
  SELECT scf, len, last, least(w, last) AS place, sum((least(e, (w + 1) * 1024) - greatest(s, w * 1024 + 1) + 1) * cov)::BIGINT AS total FROM (
    SELECT c.*, len, greatest((len + 1023) // 1024 - 2, 0) AS last, unnest(range((s - 1) // 1024, (e - 1) // 1024 + 1)) AS w FROM cover c JOIN scaffold USING (scf))
  GROUP BY scf, len, last, least(w, last))""")
def wig_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.wig_windows(views.covered(spark, sf_dir), views.scaffolds(spark, sf_dir))


@query("""SELECT x AS cov, coalesce(sum(e - s + 1), 0)::BIGINT AS bases FROM range(11) r(x) LEFT JOIN cover ON least(cov, 10) = x GROUP BY x""")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.histogram(views.covered(spark, sf_dir), 10)


@query("""SELECT scf, w // 4 AS "window", w % 4 AS col, max(cov) AS max_cov FROM (
  SELECT *, unnest(range((s - 1) // 8192, (e - 1) // 8192 + 1)) AS w FROM cover) GROUP BY scf, w""")
def coverage_maxcol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.column_maxima(views.covered(spark, sf_dir), 32_768, 4)


@query("""SELECT scf, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(begins) OVER (PARTITION BY scf ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY scf ORDER BY s) < 20 THEN 0 ELSE 1 END AS begins FROM cover WHERE cov BETWEEN 1 AND 5))
  GROUP BY scf, island""")
def supported_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.supported(views.covered(spark, sf_dir), 1, 5, width=5000)


@query("SELECT scf, s, e, cov FROM cover WHERE scf <> 2 UNION ALL SELECT scf, 1, len, 0 FROM scaffold WHERE scf = 2")
def base_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scaffold has no intervals at all."""
    return coverage.base_coverage(views.covered(spark, sf_dir).filter("scf <> 2"), views.scaffolds(spark, sf_dir))


@query("SELECT scf, s, e, cov FROM cover")
def coverage_in_short_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over bins that scaffolds and intervals cross many times."""
    spans = pairs.adjacent_spans(views.lifted(spark, sf_dir)).select("scf", F.col("pos1").alias("s"), F.col("pos2").alias("e"))
    return coverage.coverage(spans, views.scaffolds(spark, sf_dir), width=5000)


def _hits_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.hits(spark, sf_dir)
    both = found.select(F.inline(F.array(F.struct(F.col("id1").alias("tid1"), F.col("id2").alias("tid2")), F.struct(F.col("id2").alias("tid1"), F.col("id1").alias("tid2")))))
    return both.groupBy("tid1", "tid2").agg(F.count(F.lit(1)).alias("hits"))


def _true_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.placement(spark, sf_dir)
    return breaks.true_ranks(breaks.neighbour_ranks(_hits_by_pair(spark, sf_dir), placed), placed)


@query("""SELECT x AS rank, count(t.scf) AS n FROM range(1, 8) r(x) LEFT JOIN true_rank t ON least(coalesce(rank, 7), 7) = x GROUP BY x""")
def neighbour_rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.rank_histogram(_true_ranks(spark, sf_dir))


@query("SELECT DISTINCT scf, (CASE WHEN forward THEN ord ELSE ord - 1 END)::INT AS ord FROM true_rank WHERE rank IS NULL OR rank >= 3")
def missing_neighbour_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.missing_neighbours(_true_ranks(spark, sf_dir), 3)


@query("""SELECT a.scf, a.ord::INT AS ord FROM (
  SELECT ctg1, ctg2, sum(weight) FILTER (end1 = '-') AS minus, sum(weight) FILTER (end1 = '+') AS plus FROM link GROUP BY ctg1, ctg2) k
  JOIN placed a ON a.name = ctg1 JOIN placed b ON b.name = ctg2 AND b.scf = a.scf AND b.ord = a.ord + 1
  WHERE coalesce(CASE WHEN a.fwd THEN plus ELSE minus END, 0) > coalesce(CASE WHEN a.fwd THEN minus ELSE plus END, 0)
    AND (coalesce(CASE WHEN a.fwd THEN plus ELSE minus END, 0) - (coalesce(plus, 0) + coalesce(minus, 0)) / 2) / sqrt((coalesce(plus, 0) + coalesce(minus, 0)) / 4) > 0.2533471031357997""")
def orientation_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights.counted_cells(views.links(spark, sf_dir), views.contigs(spark, sf_dir))
    return breaks.doubtful_orientations(rows, views.placement(spark, sf_dir), SIGNIFICANT)


def _clear(x: str, y: str) -> str:
    return f"coalesce(({x} - ({x} + {y}) / 2) / nullif(sqrt(({x} + {y}) / 4), 0) > 0.2533471031357997, false)"


@query(
    f"""SELECT DISTINCT scf, ord FROM (
    SELECT scf, ord FROM judged WHERE NOT is_tail AND NOT coalesce(t.ord2 > ord AND (t.ord2 = ord + 1 OR (NOT {_clear("t.tl", "t.hd")} AND t.scf3 = scf AND t.ord3 = ord + 1 AND {_clear("t.tl3", "t.hd3")})), false)
    UNION ALL
    SELECT scf, ord - 1 FROM judged WHERE NOT is_head AND NOT coalesce(h.ord2 < ord AND (h.ord2 = ord - 1 OR (NOT {_clear("h.hd", "h.tl")} AND h.scf3 = scf AND h.ord3 = ord - 1 AND {_clear("h.hd3", "h.tl3")})), false))""",
    counted="""
  SELECT ctg1, ctg2, coalesce(sum(weight) FILTER (end1 = '-'), 0.0) AS minus, coalesce(sum(weight) FILTER (end1 = '+'), 0.0) AS plus FROM link GROUP BY ctg1, ctg2""",
    contact_="""
  SELECT a.scf, a.ord, b.scf AS scf2, b.ord AS ord2, tl, hd, row_number() OVER o AS place, lead(b.scf) OVER o AS scf3, lead(b.ord) OVER o AS ord3, lead(tl) OVER o AS tl3, lead(hd) OVER o AS hd3
  FROM (SELECT k.*, CASE WHEN fwd THEN minus ELSE plus END AS tl, CASE WHEN fwd THEN plus ELSE minus END AS hd FROM counted k JOIN placed p ON p.name = ctg1 WHERE ctg1 <> ctg2) k
  JOIN placed a ON a.name = ctg1 JOIN placed b ON b.name = ctg2 WINDOW o AS (PARTITION BY a.scf, a.ord ORDER BY (tl + hd) / b.len DESC, b.tid)""",
    typed=f"""
  SELECT *, CASE WHEN ord2 > ord THEN NOT {_clear("hd", "tl")} ELSE {_clear("tl", "hd")} END AS of_tail FROM contact_ WHERE scf = scf2""",
    judged="""
  SELECT p.scf, p.ord::INT AS ord, is_head, is_tail, t, h FROM placed p LEFT JOIN (
    SELECT scf, ord, min_by(typed, place) FILTER (of_tail) AS t, min_by(typed, place) FILTER (NOT of_tail) AS h FROM typed GROUP BY scf, ord) USING (scf, ord)""",
)
def misplacement_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights.counted_cells(views.links(spark, sf_dir), views.contigs(spark, sf_dir))
    return breaks.misplacements(rows, views.placement(spark, sf_dir), SIGNIFICANT)


# molecules


@query("SELECT bc, scf, s, e, n, mean_mapq FROM molecule")
def molecules_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.molecules(views.barcode_hits(spark, sf_dir), **MOLECULES)


@query("SELECT scf, s, max(e) AS e FROM molecule GROUP BY scf, s")
def molecule_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.merged_starts(molecules_found(spark, sf_dir))


# figures, sequences and exports


@query("""SELECT count(*) AS n, sum(len)::BIGINT AS total, max(len) AS longest, min(len) FILTER (before < total_ // 2) AS n50 FROM (
  SELECT len, sum(len) OVER () AS total_, coalesce(sum(len) OVER (ORDER BY len DESC, scf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scaffold)""")
def assembly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.assembly_metrics(views.scaffolds(spark, sf_dir))


#: A base string from the text of each document; five documents that follow each other are a scaffold.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.lower(F.col("text")), "[^a-z]", "")
    return views.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.translate(letters, *LETTERS).alias("seq"))


def _document_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    return views.table(spark, sf_dir, "documents").select(
        F.floor(number / 5).alias("scf"), (number % 5 + 1).cast("int").alias("ord"), F.concat(F.lit("d"), number.cast("string")).alias("name"), (number % 2 == 0).alias("fwd")
    )


SEQUENCE = f"""
  SELECT 'd' || doc_id AS name, doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS[0]}', '{LETTERS[1]}') AS seq FROM documents"""
TURNED = "translate(reverse(seq), 'ACGT', 'TGCA')"


@query(f"SELECT doc_id, md5({TURNED}) AS digest FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS[0]}', '{LETTERS[1]}') AS seq FROM documents)")
def revcomp_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.lower(F.col("text")), "[^a-z]", "")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(reverse_complement(F.translate(letters, *LETTERS))).alias("digest"))


@query(f"""SELECT doc_id // 5 AS scf, sum(length(seq) + 200)::BIGINT - 200 AS len, md5(string_agg(CASE WHEN doc_id % 2 = 0 THEN seq ELSE {TURNED} END, repeat('N', 200) ORDER BY doc_id)) AS digest
  FROM sequence_ GROUP BY doc_id // 5 HAVING coalesce(min(length(coalesce(seq, ''))), 0) > 0 AND sum(length(seq) + 200) - 200 >= 5000""", sequence_=SEQUENCE)
def scaffold_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaffolds of at least 5,000 bases, of all documents."""
    found = sequences.scaffold_sequences(_document_scaffolds(spark, sf_dir), _sequences(spark, sf_dir), min_length=5000)
    return found.select("scf", "len", F.md5("seq").alias("digest"))


@query("""SELECT s1 AS scf, p1 AS s, p1 + 100 AS e, qname || '/1' AS read, q1 AS mapq, CASE WHEN r1 THEN '-' ELSE '+' END AS strand FROM lifted
  UNION ALL SELECT s2, p2, p2 + 100, qname || '/2', q2, CASE WHEN r2 THEN '-' ELSE '+' END FROM lifted""")
def pair_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_bed(views.lifted(spark, sf_dir))


@query("SELECT scf, sum(len)::BIGINT AS len FROM element GROUP BY scf")
def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scaffold_elements(spark, sf_dir).groupBy("scf").agg(F.sum("len").alias("len"))


@query("SELECT scf, len, coalesce(sum(len) OVER (ORDER BY len DESC, scf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT scf, sum(len)::BIGINT AS len FROM element GROUP BY scf)")
def cumulative_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.axis(chrom_sizes(spark, sf_dir))


@query("""SELECT qname, CASE WHEN (CASE WHEN s1 > s2 THEN r2 ELSE r1 END) THEN 1 ELSE 0 END AS strand1, ((CASE WHEN s1 > s2 THEN p2 + b.start ELSE p1 + a.start END) // 1)::BIGINT AS x1,
  CASE WHEN (CASE WHEN s1 > s2 THEN r1 ELSE r2 END) THEN 1 ELSE 0 END AS strand2, ((CASE WHEN s1 > s2 THEN p1 + a.start ELSE p2 + b.start END) // 1)::BIGINT AS x2
  FROM lifted JOIN axis_ a ON a.scf = s1 JOIN axis_ b ON b.scf = s2""",
  axis_="SELECT scf, coalesce(sum(len) OVER (ORDER BY len DESC, scf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT scf, sum(len)::BIGINT AS len FROM element GROUP BY scf)")
def pairs_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = chrom_sizes(spark, sf_dir)
    return contacts.on_axis(views.lifted(spark, sf_dir), sizes, contacts.axis_scale(sizes)).drop("q1", "q2")


@query("""SELECT qname, ((CASE WHEN s1 > s2 THEN p2 + b.start ELSE p1 + a.start END) // 7)::BIGINT AS x1, ((CASE WHEN s1 > s2 THEN p1 + a.start ELSE p2 + b.start END) // 7)::BIGINT AS x2
  FROM lifted JOIN axis_ a ON a.scf = s1 JOIN axis_ b ON b.scf = s2""",
  axis_="SELECT scf, coalesce(sum(len) OVER (ORDER BY len DESC, scf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT scf, sum(len)::BIGINT AS len FROM element GROUP BY scf)")
def pairs_on_scaled_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As on an axis that is too long for the format."""
    return contacts.on_axis(views.lifted(spark, sf_dir), chrom_sizes(spark, sf_dir), 7).select("qname", "x1", "x2")


@query("SELECT ctg1, end1, ctg2, end2, weight * 1e5 / (zone1::DOUBLE * zone2::DOUBLE) AS w FROM link")
def links_per_zone_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.per_zone_pair(views.links(spark, sf_dir)).select(*ENDS, "w")


@query("SELECT bc, count(*) AS n FROM bc_hit GROUP BY bc")
def barcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.barcode_hits(spark, sf_dir).groupBy("bc").agg(F.count(F.lit(1)).alias("n"))


BINS = "SELECT a.s AS s1, a.b AS bin1, c.s AS s2, c.b AS bin2, count(*) AS n FROM (SELECT least({{'s': s1, 'b': p1 // {0}}}, {{'s': s2, 'b': p2 // {0}}}) AS a, greatest({{'s': s1, 'b': p1 // {0}}}, {{'s': s2, 'b': p2 // {0}}}) AS c FROM lifted) GROUP BY ALL"


@query(BINS.format(1000))
def pair_bins_1kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.binned(views.lifted(spark, sf_dir))


@query(BINS.format(10_000))
def pair_bins_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.zoomed(contacts.binned(views.lifted(spark, sf_dir)), 10)


#: Scaffolds' starts on one axis, and the pairs there, of both sides the smaller place first.
AXIS = {
    "axis_": "SELECT scf, coalesce(sum(len) OVER (ORDER BY len DESC, scf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT scf, sum(len)::BIGINT AS len FROM element GROUP BY scf)",
    "on_axis_": "SELECT p1 + a.start AS x, p2 + b.start AS y FROM lifted JOIN axis_ a ON a.scf = s1 JOIN axis_ b ON b.scf = s2 WHERE q1 >= 1 AND q2 >= 1",
}
AXIS_MAP = """SELECT w::BIGINT AS width, greatest(w // {0}, 1)::BIGINT AS bin_width, (least(x, y) // {0}) // greatest(w // {0}, 1) AS bin1, (greatest(x, y) // {0}) // greatest(w // {0}, 1) AS bin2, count(*) AS n
  FROM on_axis_, (SELECT unnest([2500000, 1000000, 500000, 250000, 100000, 50000, 25000, 10000, 5000, 1000]) AS w) GROUP BY ALL"""


@query(AXIS_MAP.format(1), **AXIS)
def axis_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of all scaffolds on one axis, at its ten widths."""
    sizes = chrom_sizes(spark, sf_dir)
    return contacts.axis_map(views.lifted(spark, sf_dir), sizes, contacts.axis_scale(sizes))


@query(AXIS_MAP.format(7), **AXIS)
def axis_map_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As on an axis that is too long for the format: widths that do not divide one another."""
    return contacts.axis_map(views.lifted(spark, sf_dir), chrom_sizes(spark, sf_dir), 7)


@query("""SELECT k::INT AS level, (1000 * 2 ** k)::BIGINT AS width, a.s AS s1, a.b AS bin1, c.s AS s2, c.b AS bin2, count(*) AS n FROM (
  SELECT k, least({'s': s1, 'b': p1 // w}, {'s': s2, 'b': p2 // w}) AS a, greatest({'s': s1, 'b': p1 // w}, {'s': s2, 'b': p2 // w}) AS c
  FROM lifted, (SELECT k, (1000 * 2 ** k)::BIGINT AS w FROM range(40) r(k) WHERE k = 0 OR 1000 * 2 ** (k - 1) <= (SELECT max(len) FROM scaffold))) GROUP BY ALL""")
def zoom_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of every zoom, until each scaffold is one bin."""
    return contacts.zoom_pyramid(views.lifted(spark, sf_dir), views.scaffolds(spark, sf_dir))


@query("""SELECT scf, string_agg((CASE WHEN fwd THEN '' ELSE '-' END) || number, ' ' ORDER BY number) AS members FROM (
  SELECT *, row_number() OVER (ORDER BY scf, ord) AS number FROM element) GROUP BY scf""")
def agp_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.placement(spark, sf_dir).withColumn("scf", F.col("scf"))
    return agp.assembly_lines(agp.rows(placed)).select(F.col("object").cast("int").alias("scf"), "members")


# files: written to the shared folder and read back


def _written(spark: SparkSession, write: Callable[[str], None]) -> str:
    path = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    write(path)
    return path


def _region_graph(spark: SparkSession, sf_dir: str) -> sat.ScaffoldGraph:
    """Regions as paths of nations, in one assembly."""
    placed = views.placement(spark, sf_dir)
    graph = scaffolding.first_graph(views.contigs(spark, sf_dir))
    elems = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "fwd"))), lambda x: F.struct(x["name"].alias("name"), x["fwd"].alias("fwd")))
    paths = placed.groupBy("scf").agg(F.max(F.col("off") + F.col("len")).alias("len"), elems.alias("elems"))
    paths = paths.select(F.format_string("u%09d", F.col("scf")).alias("name"), "len", F.lit(False).alias("is_circ"), "elems")
    return scaffolding.with_assembly(replace(graph, paths=paths), paths.select("name"))


@query("SELECT 'u' || lpad(scf::VARCHAR, 9, '0') AS path, ord::INT AS ord, name, fwd, p.len, s.len AS path_len FROM placed p JOIN scaffold s USING (scf)")
def sat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = sat.read_sat(spark, _written(spark, lambda path: sat.write_sat(_region_graph(spark, sf_dir), path)))
    sizes = graph.current_sizes().select(F.col("name").alias("path"), F.col("len").alias("path_len"))
    return graph.elements().join(sizes, "path").join(graph.sequences.select("name", "len"), "name").select("path", "ord", "name", "fwd", "len", "path_len")


@query("""SELECT 'S' AS tag, name, 'S' || chr(9) || name || chr(9) || len || chr(9) || '*' AS kept, 'S' || chr(9) || name || chr(9) || (len + tid % 3) || chr(9) || 'ACGT' AS ignored FROM contig WHERE tid % 3 > 0
  UNION ALL
  SELECT 'P', path, 'P' || chr(9) || path || chr(9) || len || chr(9) || elems, 'P' || chr(9) || path || chr(9) || '0' || chr(9) || 'nothing+' FROM (
    SELECT 'u' || lpad(scf::VARCHAR, 9, '0') AS path, max(off + len) AS len, string_agg(name || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY ord) AS elems FROM placed WHERE scf % 2 = 0 GROUP BY scf)""")
def sat_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind a graph's own that say other lengths of some sequences, fill in bases of others, and repeat names of paths."""
    graph = _region_graph(spark, sf_dir)
    own = sat.lines_of(graph)
    again = views.contigs(spark, sf_dir).select(F.lit(8).alias("section"), F.col("name").alias("ord"), F.concat_ws("\t", F.lit("S"), "name", (F.col("len") + F.col("tid") % 3).cast("string"), F.lit("ACGT")).alias("value"))
    taken = graph.paths.filter(F.right("name", F.lit(1)).cast("int") % 2 == 0).select(F.lit(9).alias("section"), F.col("name").alias("ord"), F.concat_ws("\t", F.lit("P"), "name", F.lit("0"), F.lit("nothing+")).alias("value"))
    return sat.conflicts(spark, _written(spark, lambda path: text.write_lines(own.unionByName(again).unionByName(taken), path)))


@query(f"SELECT {CELLS.format('weight')} FROM link")
def links_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_links(spark, _written(spark, lambda path: text.write_links(views.links(spark, sf_dir), path)))


@query("SELECT (row_number() OVER (ORDER BY tid) - 1)::INT AS tid, name, len FROM contig")
def fai_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.contigs(spark, sf_dir).select(F.concat_ws("\t", "name", F.col("len").cast("string"), F.col("tid").cast("string"), F.lit("60"), F.lit("61")).alias("value"))
    found = text.read_fai(spark, _written(spark, lambda path: lines.write.text(path)))
    return text.contigs(found).select("tid", "name", "len")


@query("SELECT row_number() OVER (ORDER BY scf, ord) AS number, scf::VARCHAR AS object, name AS comp, len, CASE WHEN fwd THEN '+' ELSE '-' END AS orient FROM element")
def agp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = agp.agp_lines(views.placement(spark, sf_dir))
    return agp.read_agp(spark, _written(spark, lambda path: lines.orderBy("scf", "part").select("value").write.text(path)))


@query("SELECT name, length(seq)::BIGINT AS len, md5(seq) AS digest FROM sequence_ WHERE seq <> ''", sequence_=SEQUENCE)
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fasta.read_fasta(spark, _written(spark, lambda path: fasta.write_fasta(_sequences(spark, sf_dir), path)))
    return found.select("name", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


#: Line items as records of a file; tids as in a list of contigs that goes the other way.
FLAG = "CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_quantity < 6 THEN 4 ELSE 0 END"
AS_RECORD = {
    "filed": f"""
  SELECT 'o' || l_orderkey || '-' || lpad((l_suppkey % 40)::VARCHAR, 16, '0') AS qname, ({FLAG})::INT AS flag, (l_suppkey % 25)::INT AS tid, (l_partkey * 31)::INT AS pos0, CAST(l_quantity AS SMALLINT) AS mapq,
         CASE WHEN l_partkey % 11 = 0 THEN '' ELSE '50' || CASE WHEN l_linestatus = 'O' THEN 'M' ELSE 'S' END || '50' || CASE WHEN l_partkey % 3 > 0 THEN 'M' ELSE 'S' END END AS cigar,
         lpad((l_suppkey % 40)::VARCHAR, 16, '0') AS barcode, CAST(l_suppkey % 25 AS INT) AS mate_tid
  FROM lineitem""",
}


def _bam(spark: SparkSession, sf_dir: str) -> str:
    """Line items in BAM files, with their barcodes and strands as tags."""
    found = views.records(spark, sf_dir).withColumn("mate_tid", F.col("tid"))
    reverse = F.col("flag").bitwiseAND(16) != 0
    tags = F.create_map(F.lit("BX"), F.right("qname", F.lit(16)), F.lit("RV"), F.when(reverse, "yes").otherwise("no"))
    return _written(spark, lambda path: bam.write_bam(found.withColumn("tags", tags), views.contigs(spark, sf_dir), path))


def _cigar_text() -> Column:
    step = lambda x: F.concat(x["len"].cast("string"), F.substring(F.lit("MIDNSHP=X"), x["op"] + 1, F.lit(1)))
    return F.array_join(F.transform("cigar", step), "")


@query("SELECT qname, flag, (24 - tid)::INT AS tid, pos0, mapq, cigar, barcode, mate_tid, CASE WHEN flag & 16 <> 0 THEN 'yes' ELSE 'no' END AS reverse FROM filed", **AS_RECORD)
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their tags, brought by name to a list that has the contigs the other way round."""
    path = _bam(spark, sf_dir)
    known = views.contigs(spark, sf_dir).select((24 - F.col("tid")).alias("tid"), "name", "len")
    found = bam.by_name(bam.read_bam(spark, path), bam.read_bam(spark, path, kind="targets"), known)
    return found.select("qname", "flag", F.col("tid").cast("int").alias("tid"), "pos0", "mapq", _cigar_text().alias("cigar"), F.col("tags")["BX"].alias("barcode"), "mate_tid", F.col("tags")["RV"].alias("reverse"))


@query("SELECT tid, flag, count(*) AS n, sum(pos0)::BIGINT AS pos0, min(mapq)::INT AS mapq FROM filed WHERE mapq >= 30 AND tid IN (3, 7, 11) AND flag & 16 = 16 AND flag & 4 = 0 GROUP BY tid, flag", **AS_RECORD)
def bam_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters go down to the fixed fields of the records, and nothing else is decoded."""
    found = bam.read_bam(spark, _bam(spark, sf_dir), columns="flag,tid,pos0,mapq", withFlags="16", withoutFlags="4").filter("mapq >= 30 and tid in (3, 7, 11)")
    return found.groupBy("tid", "flag").agg(F.count(F.lit(1)).alias("n"), F.sum("pos0").alias("pos0"), F.min(F.col("mapq").cast("int")).alias("mapq"))


@query("SELECT tid::INT AS tid, name, len FROM contig")
def bam_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bam.read_bam(spark, _bam(spark, sf_dir), kind="targets").select("tid", "name", "len").distinct()


@query("SELECT scf::VARCHAR AS name, s, e, cov AS f4 FROM cover")
def bedgraph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_track(spark, _written(spark, lambda path: tracks.write_bedgraph(views.covered(spark, sf_dir), path))).select("name", "s", "e", "f4")


@query("""SELECT 'coverage of pairs' AS name, '' AS description""")
def track_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = coverage.wig_windows(views.covered(spark, sf_dir), views.scaffolds(spark, sf_dir))
    return text.track_header(spark, _written(spark, lambda path: tracks.write_wig(windows, path, "coverage of pairs")))


@query("""SELECT scf, start AS s, cov FROM (
  SELECT scf, (place * 1024 + 1)::BIGINT AS start, (total // (CASE WHEN place = last THEN len - last * 1024 ELSE 1024 END))::BIGINT AS cov FROM (
    SELECT scf, len, last, least(w, last) AS place, sum((least(e, (w + 1) * 1024) - greatest(s, w * 1024 + 1) + 1) * cov)::BIGINT AS total FROM (
      SELECT c.*, len, greatest((len + 1023) // 1024 - 2, 0) AS last, unnest(range((s - 1) // 1024, (e - 1) // 1024 + 1)) AS w FROM cover c JOIN scaffold USING (scf))
    GROUP BY scf, len, last, least(w, last)))""")
def wig_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a wiggle file of several parts, numbered by the lines before them."""
    windows = coverage.wig_windows(views.covered(spark, sf_dir), views.scaffolds(spark, sf_dir))
    found = tracks.read_wig(spark, _written(spark, lambda path: tracks.write_wig(windows, path, "coverage of pairs")))
    return found.select(F.col("scf").cast("int").alias("scf"), "s", "cov")


@query("SELECT 'u' || lpad(scf::VARCHAR, 9, '0') AS path, ord::INT AS ord, name, fwd, len, (SELECT count(*) FROM joined WHERE ctg1 || end1 < ctg2 || end2) AS joins FROM placed")
def gfa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of regions with the best joins of ends, without assemblies."""
    graph = _region_graph(spark, sf_dir)
    joins = _joins(spark, sf_dir).select(F.col("ctg1").alias("v"), F.col("end1").alias("v_end"), F.col("ctg2").alias("w"), F.col("end2").alias("w_end"), F.col("w").alias("wt"))
    found = sat.read_gfa(spark, _written(spark, lambda path: text.write_lines(sat.gfa_lines(replace(graph, joins=joins)), path)))
    joined = found.joins.agg(F.count(F.lit(1)).alias("joins"))
    return found.elements().join(found.sequences.select("name", "len"), "name").join(F.broadcast(joined)).select("path", "ord", "name", "fwd", "len", "joins")


@query("SELECT DISTINCT ctg1 AS name FROM link JOIN contig ON name = ctg1 WHERE tid % 4 = 1")
def unknown_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links name and a list of contigs does not have."""
    return weights.unknown_contigs(views.links(spark, sf_dir), views.contigs(spark, sf_dir).filter("tid % 4 <> 1"))


# the whole pipeline


def _renamed(ctes: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """Common table expressions under other names, which they use for one another too."""
    pattern = re.compile(rf"\b({'|'.join(names)})\b")
    return {names[k]: pattern.sub(lambda m: names[m[1]], v) for k, v in ctes.items() if k in names}


def _unrolled() -> dict[str, str]:
    """Two rounds and the break at their end: the second round joins the paths of the first, whose contigs carry the pairs."""
    out = {"walk": WALK, "cycle": CYCLE, "chosen": CHOSEN}
    out["path_a"] = """
  SELECT head, is_circ, (CASE WHEN is_circ THEN 'c' ELSE 'u' END) || lpad((row_number() OVER (ORDER BY head) - 1)::VARCHAR, 9, '0') AS name, (sum(len) + 200 * (count(*) - 1))::BIGINT AS len
  FROM chosen JOIN contig USING (name) GROUP BY head, is_circ"""
    out["element_a"] = "SELECT p.name AS scf, ord, tid, c.name, fwd, c.len FROM chosen JOIN contig c USING (name) JOIN path_a p USING (head)"
    out |= _renamed({k: views.CTES[k] for k in ("placed", "lifted")}, {"element": "element_a", "placed": "placed_a", "lifted": "lifted_a"})
    out["hit_a"] = """
  SELECT DISTINCT least(s1, s2) AS id1, CASE WHEN s1 < s2 THEN p1 ELSE p2 END AS pos1, CASE WHEN s1 < s2 THEN r1 ELSE r2 END AS rev1,
         greatest(s1, s2) AS id2, CASE WHEN s1 < s2 THEN p2 ELSE p1 END AS pos2, CASE WHEN s1 < s2 THEN r2 ELSE r1 END AS rev2 FROM lifted_a WHERE s1 <> s2"""
    out["third_a"] = "SELECT name AS tid, name, len, len // 3 AS l, (2 * len) // 3 + 1 AS r FROM path_a WHERE NOT is_circ"
    second = {k: f"{k}_a" for k in ("third", "hit", "link", "link_end", "link_both", "contig", "weighed", "ranked", "mutual", "only_best", "joined", "walk", "cycle", "chosen")} | {"contig": "path_a"}
    out |= _renamed({k: {**views.CTES, **out}[k] for k in second if k not in ("third", "hit", "contig")}, second)
    out["path_b"] = """
  SELECT c.head, c.is_circ OR (count(*) = 1 AND bool_or(p.is_circ)) AS is_circ, (CASE WHEN c.is_circ OR (count(*) = 1 AND bool_or(p.is_circ)) THEN 'c' ELSE 'u' END)
         || lpad(((SELECT count(*) FROM path_a) + row_number() OVER (ORDER BY c.head) - 1)::VARCHAR, 9, '0') AS name
  FROM chosen_a c JOIN path_a p ON p.name = c.name GROUP BY c.head, c.is_circ"""
    out["element_b"] = """
  SELECT p.name AS scf, row_number() OVER (PARTITION BY p.name ORDER BY c.ord, CASE WHEN c.fwd THEN e.ord ELSE -e.ord END) AS ord, e.tid, e.name, e.fwd = c.fwd AS fwd, e.len
  FROM chosen_a c JOIN path_b p ON p.head = c.head JOIN element_a e ON e.scf = c.name"""
    third = {k: f"{k}_b" for k in ("placed", "lifted", "span", "scaffold", "change", "cover", "stat", "cut")} | {"region_": "region_b", "element": "element_b"}
    out |= _renamed({k: views.CTES[k] for k in third if k != "element"}, third)
    out["piece_b"] = """
  SELECT e.*, count(c.ord) OVER (PARTITION BY e.scf ORDER BY e.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece FROM element_b e LEFT JOIN cut_b c ON c.scf = e.scf AND c.ord = e.ord"""
    out["later_b"] = """
  SELECT scf, piece, 'u' || lpad(((SELECT count(*) FROM path_a) + (SELECT count(*) FROM path_b) + row_number() OVER (ORDER BY scf, piece) - 1)::VARCHAR, 9, '0') AS path
  FROM (SELECT DISTINCT scf, piece FROM piece_b WHERE piece > 0)"""
    return out


@query(
    """SELECT coalesce(path, scf) AS scf, (row_number() OVER w)::INT AS ord, name, fwd, len, coalesce(sum(len + 200) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM piece_b LEFT JOIN later_b USING (scf, piece) WINDOW w AS (PARTITION BY scf, piece ORDER BY ord)""",
    **_unrolled(),
)
def scaffold_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From alignments to scaffolds: link and build twice, then break where hardly any pair spans a gap; contigs on the last assembly's paths."""
    options = scaffolding.Options(rounds=2, min_weight=0, candidates=TOP, break_ratio=CUT_RATIO)
    graph, _ = scaffolding.scaffold(views.alignments(spark, sf_dir), views.contigs(spark, sf_dir), options)
    return scaffolding.current_placement(graph).select("scf", "ord", "name", "fwd", "len", "off")


#: Paths of regions cut behind the elements in cut_on (scf, ord): the first piece keeps its name, later ones get the next free numbers.
PIECES = {
    "piece_on": """
  SELECT e.*, count(c.ord) OVER (PARTITION BY e.scf ORDER BY e.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece FROM element e LEFT JOIN cut_on c ON c.scf = e.scf AND c.ord = e.ord""",
    "later_on": """
  SELECT scf, piece, (SELECT count(DISTINCT scf) FROM element) + row_number() OVER (ORDER BY scf, piece) - 1 AS number FROM (SELECT DISTINCT scf, piece FROM piece_on WHERE piece > 0)""",
}
PLACED_PIECES = """SELECT 'u' || lpad(coalesce(number, scf)::VARCHAR, 9, '0') AS scf, (row_number() OVER w)::INT AS ord, name, fwd, len, coalesce(sum(len + 200) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM piece_on LEFT JOIN later_on USING (scf, piece) WINDOW w AS (PARTITION BY scf, piece ORDER BY ord)"""


def _current(graph: sat.ScaffoldGraph) -> DataFrame:
    return scaffolding.current_placement(graph).select("scf", "ord", "name", "fwd", "len", "off")


@query(
    PLACED_PIECES,
    contact="SELECT a.tid AS tid1, b.tid AS tid2, sum(n) AS hits FROM link JOIN contig a ON a.name = ctg1 JOIN contig b ON b.name = ctg2 GROUP BY a.tid, b.tid",
    cut_on="SELECT DISTINCT scf, CASE WHEN forward THEN ord ELSE ord - 1 END AS ord FROM true_rank WHERE rank IS NULL OR rank >= 3",
    **PIECES,
)
def scaffolds_broken_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions cut where a neighbour is not among the best contacts of either side."""
    return _current(scaffolding.break_by_neighbours(views.links(spark, sf_dir), views.contigs(spark, sf_dir), _region_graph(spark, sf_dir), limit=3))


@query(
    PLACED_PIECES,
    bc_hit="""
  SELECT right(qname, 16) AS bc, scf, off + CASE WHEN fwd THEN pos ELSE len - pos END AS pos, mapq FROM record JOIN placed USING (tid) WHERE mapped AND is_r1 AND mapq >= 20""",
    span="SELECT scf, s AS pos1, max(e) AS pos2 FROM molecule GROUP BY scf, s",
    cut_on="SELECT scf, ord FROM cut",
    **PIECES,
)
def scaffolds_broken_by_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions cut where hardly any molecule of linked reads spans a gap."""
    hits = molecules.barcode_hits(views.records(spark, sf_dir), min_mapq=20)
    return _current(scaffolding.break_by_molecules(hits, views.contigs(spark, sf_dir), _region_graph(spark, sf_dir), CUT_RATIO, **MOLECULES).graph)


@query("SELECT flag, tid, count(*) AS n, sum(pos0)::BIGINT AS pos0, 0::BIGINT AS holes FROM filed GROUP BY flag, tid", **AS_RECORD)
def bams_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of BAM files, decoded once to Parquet; records of each file are numbered without holes."""
    found, known = views.records(spark, sf_dir), views.contigs(spark, sf_dir)
    odd = F.col("flag").bitwiseAND(0x40) != 0
    paths = [_written(spark, lambda path, part=part: bam.write_bam(found.filter(part), known, path)) for part in (odd, ~odd)]
    decoded = _written(spark, lambda path: bam.to_parquet(spark, paths, path))
    read = bam.from_parquet(spark, decoded)
    holes = read.groupBy("file_id").agg((F.max("rec_no") + 1 - F.countDistinct("rec_no")).alias("holes")).agg(F.coalesce(F.sum("holes"), F.lit(0)).alias("holes"))
    named = bam.by_name(read, bam.from_parquet(spark, decoded, "targets"), known)
    return named.groupBy("flag", "tid").agg(F.count(F.lit(1)).alias("n"), F.sum("pos0").alias("pos0")).join(F.broadcast(holes)).select("flag", F.col("tid").cast("int").alias("tid"), "n", "pos0", "holes")
