"""Maximum spanning forests of contacts, of ends and of contigs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import iterate
from .candidates import swapped
from .chains import ranked_chains
from .iterate import settled

#: Weights of forest edges are written in millionths.
UNIT = 1_000_000
#: The edge between the two ends of a contig outweighs all contacts.
INSIDE = float("inf")


def _heaviest(w: str = "w"):  # noqa: ANN202
    """Total order of edges: by weight, then by the smaller names."""
    return F.struct((-F.col(w)).alias("w"), "a", "b")


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a small graph, by edges in order."""
    edges = pd.concat(list(batches) or [pd.DataFrame({"a": [], "b": [], "w": []})])
    ordered = edges.assign(less=-edges["w"]).sort_values(["less", "a", "b"])
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    kept = []
    for a, b in zip(ordered["a"], ordered["b"], strict=True):
        x, y = root(a), root(b)
        up[x] = y
        kept.append(x != y)
    yield ordered[["a", "b", "w"]][kept]


def spanning_forest(edges: DataFrame, small: int | None = None) -> DataFrame:
    """Edges (a, b, w), a < b, of the maximum spanning forest.

    Each round every tree takes its heaviest edge out, and the trees so joined become one:
    trees halve at least, so rounds grow with the logarithm of the nodes.  The graph is
    contracted as they do: edges inside a tree go, and of those between the same two trees the
    heaviest stays, so every round reads a smaller table than the one before.  With ties broken
    by name the forest is unique, and a graph small enough for one task (``small`` edges) is sorted there instead.
    """
    edges = settled(edges.filter("a < b").groupBy("a", "b").agg(F.max("w").alias("w")))
    if edges.count() <= (iterate.SMALL_GRAPH if small is None else small):
        return edges.coalesce(1).mapInPandas(_kruskal, edges.schema)
    chosen, left = None, edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "w")  # x, y: the trees that an edge lies between
    while left.limit(1).count():
        best, taken = _heaviest_out(left)
        chosen = settled(taken if chosen is None else chosen.unionByName(taken))
        left = contracted(left, _roots(best))
    return edges.limit(0) if chosen is None else chosen


def _heaviest_out(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each tree the tree at the other end of its heaviest edge, (tree, other), and the edges taken."""
    way = lambda x, y: F.struct(F.col(x).alias("tree"), F.col(y).alias("other"), "a", "b", "w")
    both = left.select(F.inline(F.array(way("x", "y"), way("y", "x"))))
    best = settled(both.groupBy("tree").agg(F.min_by(F.struct("other", "a", "b", "w"), _heaviest()).alias("edge")).select("tree", "edge.*"))
    return best.select("tree", "other"), best.select("a", "b", "w").distinct()


def _roots(best: DataFrame) -> DataFrame:
    """(tree, up): the tree that each is now part of.

    Trees point at one another along the edges taken; of each group two point at each other, and the smaller of these is its root.
    """
    back = best.select(F.col("tree").alias("other"), F.col("other").alias("to"))
    mutual = (F.col("to") == F.col("tree")) & (F.col("tree") < F.col("other"))
    root = best.join(back, "other", "left").select("tree", F.when(mutual, F.col("tree")).otherwise(F.col("other")).alias("up"))
    while True:
        root = settled(root)
        higher = root.select(F.col("tree").alias("up"), F.col("up").alias("top"))
        moved = settled(root.join(higher, "up").select("tree", "up", "top"))
        if not moved.filter("up <> top").limit(1).count():
            return root
        root = moved.select("tree", F.col("top").alias("up"))


def contracted(left: DataFrame, root: DataFrame) -> DataFrame:
    """Edges (x, y, a, b, w) between the trees that root (tree, up) makes of x and y, at most one for two trees."""
    end = lambda c: root.select(F.col("tree").alias(c), F.col("up").alias(f"{c}_up"))
    between = left.join(end("x"), "x").join(end("y"), "y").filter("x_up <> y_up")
    grouped = between.groupBy(F.least("x_up", "y_up").alias("x"), F.greatest("x_up", "y_up").alias("y"))
    return settled(grouped.agg(F.min_by(F.struct("a", "b", "w"), _heaviest()).alias("edge")).select("x", "y", "edge.*"))


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def without_branches(edges: DataFrame) -> DataFrame:
    """Edges (a, b, w) of which neither node has more than two."""
    branching = _degrees(edges).filter("degree > 2").select("node")
    return edges.join(branching.withColumnRenamed("node", "a"), "a", "left_anti").join(branching.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b", "w")


def end_forest(mutual: DataFrame, small: int | None = None) -> DataFrame:
    """Directed edges (ctg1, end1, ctg2, end2, w), both ways, of the forest over ends.

    The two ends of a contig are tied more firmly than any contact; ends of more than two
    edges lose all theirs.
    """
    mutual = settled(mutual)
    node = lambda i: F.concat(F.col(f"ctg{i}"), F.col(f"end{i}"))
    links = mutual.select(node(1).alias("x"), node(2).alias("y"), "w").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")
    names = mutual.select(F.col("ctg1").alias("c")).union(mutual.select("ctg2")).distinct()
    inside = names.select(F.concat("c", F.lit("+")).alias("a"), F.concat("c", F.lit("-")).alias("b"), F.lit(INSIDE).alias("w"))
    forest = without_branches(settled(spanning_forest(links.unionByName(inside), small))).filter(F.col("w") < INSIDE)
    part = lambda c, i: [F.expr(f"left({c}, length({c}) - 1)").alias(f"ctg{i}"), F.expr(f"right({c}, 1)").alias(f"end{i}")]
    one = forest.select(*part("a", 1), *part("b", 2), (F.col("w") * UNIT).alias("w"))
    return one.unionByName(swapped(one))


def _best_directions(chain: pd.DataFrame) -> pd.DataFrame:
    """Viterbi over the two directions of the contigs of one chain, in order of rank."""
    chain = chain.sort_values("rank")
    names = chain["name"].tolist()
    steps = chain[["mm", "mp", "pm", "pp"]].to_numpy()[1:].tolist()  # of each contig with the one before
    score, back = {True: 0.0, False: 0.0}, []
    weight = lambda cell, before, now: cell[(0 if before else 2) + (1 if now else 0)]  # noqa: E731  forward leaves by "-", enters by "+"
    for cell in steps:
        best = {now: max(((score[was] + weight(cell, was, now), was) for was in (True, False)), key=lambda x: (x[0], x[1])) for now in (True, False)}
        back.append({now: was for now, (_, was) in best.items()})
        score = {now: s for now, (s, _) in best.items()}
    way = [max((True, False), key=lambda x: (score[x], x))]
    for step in reversed(back):
        way.append(step[way[-1]])
    way.reverse()
    rows = [(names[i], "-" if way[i] else "+", names[i + 1], "+" if way[i + 1] else "-", weight(steps[i], way[i], way[i + 1])) for i in range(len(steps))]
    return pd.DataFrame(rows, columns=["ctg1", "end1", "ctg2", "end2", "w"])


def contig_forest(cell_rows: DataFrame, small: int | None = None) -> DataFrame:
    """Directed edges (ctg1, end1, ctg2, end2, w), both ways, of the forest over contigs.

    cell_rows: mutual candidates (ctg1, ctg2, mm, mp, pm, pp, best).  Contigs of more than two
    edges lose all theirs; along each chain that is left, the directions with the largest
    summed weight are found by dynamic programming, a task for each chain.
    """
    cell_rows = settled(cell_rows)
    links = cell_rows.select(F.least("ctg1", "ctg2").alias("a"), F.greatest("ctg1", "ctg2").alias("b"), F.col("best").alias("w"))
    forest = settled(without_branches(spanning_forest(links, small)))
    near = settled(forest.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(forest.select(F.col("b").alias("node"), F.col("a").alias("next"))))
    # a state is a contig and the one it was reached from; chains have no cycles
    mark = F.lit("\t")
    arrivals = near.select(F.col("next").alias("name"), F.col("node").alias("before"))
    ends = near.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("node").alias("name"), F.lit(None).cast("string").alias("before"))
    states = arrivals.unionByName(ends)
    earlier = states.select(F.col("name").alias("before"), F.col("before").alias("earlier"))
    joined = states.join(earlier, "before", "left").filter(F.col("before").isNull() | F.col("earlier").isNull() | (F.col("earlier") != F.col("name")))
    state = lambda a, b: F.concat(a, mark, F.coalesce(b, F.lit("")))
    pred = F.when(F.col("before").isNotNull(), state(F.col("before"), F.col("earlier")))
    # the state before an inner contig is that of its other neighbour, before a contig next to an end that of the end itself
    ranks = ranked_chains(joined.select(state(F.col("name"), F.col("before")).alias("state"), pred.alias("pred")), small)
    ranks = ranks.select("head", "rank", F.split("state", "\t")[0].alias("name"), F.split("state", "\t")[1].alias("before"), F.split("head", "\t")[0].alias("first"))
    tails = ranks.groupBy("head").agg(F.max_by("name", "rank").alias("tail"))
    one_way = ranks.join(tails, "head").filter("first < tail")
    with_cells = one_way.join(cell_rows.select(F.col("ctg1").alias("before"), F.col("ctg2").alias("name"), "mm", "mp", "pm", "pp"), ["before", "name"], "left").select("first", "rank", "name", "mm", "mp", "pm", "pp")
    one = with_cells.groupBy("first").applyInPandas(_best_directions, "ctg1 string, end1 string, ctg2 string, end2 string, w double").withColumn("w", F.col("w") * UNIT)
    return one.unionByName(swapped(one))
