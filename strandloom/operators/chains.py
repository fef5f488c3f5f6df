"""Chains of joined ends, nested paths and names of paths.

A state is a contig entered at one of its ends; it leaves by the other end, and a join leads
to the next state.  As an end has at most one join, states form chains and cycles, which come
in pairs of the two directions.  Chains are ranked by pointer doubling: after k rounds a state
knows the one 2 ** k before it, so the rounds grow with the logarithm of the longest chain.
A graph small enough for one task is walked there instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import GAP, opposite
from . import iterate
from .iterate import running, settled


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks the chains of a small graph one after the other."""
    pred: dict[str, str | None] = {}
    for batch in batches:
        pred.update(zip(batch["state"], batch["pred"].where(batch["pred"].notna(), None), strict=True))
    after = {p: s for s, p in pred.items() if p is not None}
    out: list[tuple[str, str, int, bool]] = []
    seen: set[str] = set()
    heads = [s for s, p in pred.items() if p is None]
    for cycle, firsts in ((False, heads), (True, sorted(pred))):  # what no head leads to are cycles, met at their smallest state
        for head in firsts:
            state, rank = head, 0
            while state is not None and state not in seen:
                seen.add(state)
                out.append((state, head, rank, cycle))
                state, rank = after.get(state), rank + 1
    yield pd.DataFrame(out, columns=["state", "head", "rank", "is_cycle"]).astype({"rank": "int64", "is_cycle": "bool"})


def ranked_chains(states: DataFrame, small: int | None = None) -> DataFrame:
    """states (state, pred; pred null at a head) as (state, head, rank, is_cycle); states sort by name.

    The head of a cycle is its smallest state, and ranks go on from there.  ``small``: graphs of up to so many
    states are walked by one task.
    """
    states = settled(states)
    count = states.count()
    if count <= (iterate.SMALL_GRAPH if small is None else small):
        return states.coalesce(1).mapInPandas(_walked, "state string, head string, rank long, is_cycle boolean")
    key = F.coalesce("pred", F.col("state"))
    now = settled(states.select("state", key.alias("to"), F.col("pred").isNotNull().cast("long").alias("steps"), F.least(F.col("state"), key).alias("least")))
    rounds = ceil(log2(max(2, count))) + 1
    heads = states.filter("pred is null").select(F.col("state").alias("to"))
    for _ in range(rounds):
        if not now.join(heads, "to", "left_anti").limit(1).count():
            break
        ahead = now.select(F.col("state").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        now = settled(now.join(ahead, "to").select("state", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least")))
    chains = now.join(heads, "to", "left_semi").select("state", F.col("to").alias("head"), F.col("steps").alias("rank"), F.lit(False).alias("is_cycle"))
    cyclic = now.join(heads, "to", "left_anti")
    if not cyclic.limit(1).count():
        return chains
    # cut each cycle before its smallest state and rank what is then a chain
    cut = states.join(cyclic.select("state", "least"), "state").select("state", F.when(F.col("state") != F.col("least"), F.col("pred")).alias("pred"))
    return chains.unionByName(ranked_chains(cut, small).withColumn("is_cycle", F.lit(True)))


def scaffold_elements(joins: DataFrame, contigs: DataFrame, small: int | None = None) -> DataFrame:
    """(head, is_circ, ord, name, fwd, len): every contig (name, len, is_circ) once, in one path.

    joins: directed, both ways, at most one for each end.  A path begins at the end whose
    contig has the smaller name; a contig alone runs forward and keeps its own is_circ; a
    cycle begins with its smallest contig, forward.
    """
    mark = F.lit("\x01")  # a state is written as its contig and end; the mark sorts before all that names have
    enters = joins.select(F.col("ctg2").alias("name"), F.col("end2").alias("enter"), F.concat("ctg1", mark, opposite(F.col("end1"))).alias("pred"))
    both = contigs.select("name", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("enter"))
    state = F.concat("name", mark, "enter")
    states = both.join(enters, ["name", "enter"], "left").select(state.alias("state"), "pred")
    ranked = ranked_chains(states, small).select("*", F.right("state", F.lit(1)).alias("enter"), F.substring_index("state", "\x01", 1).alias("name"), F.substring_index("head", "\x01", 1).alias("first"))
    whole = ranked.groupBy("head").agg(F.max_by("name", "rank").alias("tail"), F.min("name").alias("smallest"), F.count(F.lit(1)).alias("n"))
    starts_right = F.when(F.col("is_cycle") | (F.col("n") == 1), F.right("head", F.lit(1)) == "+").otherwise(F.col("first") < F.col("tail"))
    chosen = ranked.join(whole, "head").filter(starts_right)
    placed = chosen.join(contigs.select("name", "len", F.col("is_circ").alias("own")), "name")
    circular = F.col("is_cycle") | ((F.col("n") == 1) & F.col("own"))
    return placed.select(F.col("first").alias("head"), circular.alias("is_circ"), (F.col("rank") + 1).cast("int").alias("ord"), "name", (F.col("enter") == "+").alias("fwd"), "len")


def paths_of(elements: DataFrame) -> DataFrame:
    """(head, is_circ, n, len, elems) of path elements; GAP bases lie between neighbours."""
    elems = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "fwd"))), lambda x: F.struct(x["name"].alias("name"), x["fwd"].alias("fwd")))
    grouped = elements.groupBy("head", "is_circ").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"), elems.alias("elems"))
    return grouped.select("head", "is_circ", "n", (F.col("bases") + GAP * (F.col("n") - 1)).alias("len"), "elems")


def placements(elements: DataFrame, scaffold: str = "head") -> DataFrame:
    """Elements (scaffold, ord, name, fwd, len) with off (where each begins), is_head and is_tail."""
    along = Window.partitionBy(scaffold).orderBy("ord")
    before = F.sum(F.col("len") + GAP).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return elements.select("*", F.coalesce(before, F.lit(0)).cast("long").alias("off"), F.lag("ord").over(along).isNull().alias("is_head"), F.lead("ord").over(along).isNull().alias("is_tail"))


def named_paths(paths: DataFrame, taken: DataFrame | None = None, first: int = 0) -> DataFrame:
    """paths with ``name``: u or c (circular) and nine digits, counted in the order of their heads from ``first``.

    Names in ``taken`` (name) are passed over: free numbers are dealt out among as many again.
    """
    numbered = running(paths, [F.col("head")], F.lit(1)).withColumnRenamed("before", "number")
    letter = F.when(F.col("is_circ"), F.lit("c")).otherwise(F.lit("u"))
    if taken is None:
        return numbered.withColumn("name", F.concat(letter, F.format_string("%09d", F.col("number") + first))).drop("number")
    used = settled(taken.select(F.regexp_extract("name", "^[uc]([0-9]{9})$", 1).try_cast("long").alias("id")).filter("id is not null").distinct())
    room = numbered.count() + used.count()
    free = running(paths.sparkSession.range(first, first + room).join(used, "id", "left_anti"), [F.col("id")], F.lit(1)).withColumnRenamed("before", "number")
    return numbered.join(free, "number").withColumn("name", F.concat(letter, F.format_string("%09d", "id"))).drop("number", "id")


def flattened(elements: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ord, name, fwd): paths taken apart down to contigs.

    elements: (path, ord, name, fwd), where a name may be another path; roots: (root).  Each
    round opens the paths of one level; inside a path that runs backwards the order and all
    directions turn.  Raises if paths contain each other.
    """
    paths = elements.select(F.col("path").alias("name"), F.col("ord").alias("ord2"), F.col("name").alias("name2"), F.col("fwd").alias("fwd2"))
    depth = elements.select("path").distinct().count()
    now = roots.join(elements, F.col("root") == F.col("path")).select("root", F.array(F.col("ord").cast("long")).alias("key"), "name", "fwd")
    done = None
    for _ in range(depth + 1):
        now = settled(now)
        nested = now.join(paths.select("name").distinct(), "name", "left_semi")
        flat = now.join(paths.select("name").distinct(), "name", "left_anti")
        done = flat if done is None else done.unionByName(flat)
        if not nested.limit(1).count():
            order = Window.partitionBy("root").orderBy("key")
            return done.select("root", F.row_number().over(order).alias("ord"), "name", "fwd")
        place = F.when(F.col("fwd"), F.col("ord2")).otherwise(-F.col("ord2")).cast("long")
        now = nested.join(paths, "name").select("root", F.concat("key", F.array(place)).alias("key"), F.col("name2").alias("name"), (F.col("fwd") == F.col("fwd2")).alias("fwd"))
    raise ValueError("paths contain each other")
