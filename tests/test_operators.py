"""Operators on inputs small enough to work out by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.expressions import reverse_complement, zone, zone_borders
from strandloom.operators import breaks, candidates, chains, contacts, coverage, forest, iterate, matching, metrics, molecules, pairs, sequences, weights

EDGE = "ctg1 string, end1 string, ctg2 string, end2 string, w double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def record(qname, flag, ops="0", rec_no=0, mapq=30, tid=0, pos0=9):
    return (0, rec_no, qname, flag, tid, pos0, mapq, [(int(o), 50) for o in ops])


def alignments(spark, records):
    numbered = [(f, i, *rest) for i, (f, _, *rest) in enumerate(records)]
    return pairs.from_records(spark.createDataFrame(numbered, "file_id int, rec_no long, qname string, flag int, tid int, pos0 int, mapq int, cigar array<struct<op: int, len: int>>"))


def test_pair_filter(spark):
    """One five-prime record of each read among at most two; unmapped ones count as records; runs, not names, are templates."""
    found = pairs.accepted_pairs(alignments(spark, [
        record("ok", 0x40), record("ok", 0x80), record("ok", 0x80, "40"),
        record("many", 0x40), record("many", 0x80), record("many", 0x80, "40"), record("many", 0x80, "40"),
        record("clipped", 0x40, "40"), record("clipped", 0x80),
        record("turned", 0x40 | 0x10, "40"), record("turned", 0x80 | 0x10, "40"),
        record("back", 0x40 | 0x10, "04"), record("back", 0x80),
        record("ok", 0x40), record("ok", 0x80, mapq=9),
        record("unmapped", 0x40), record("unmapped", 0x80), record("unmapped", 0x80 | 0x4),
        record("lost", 0x40), record("lost", 0x80 | 0x4),
    ]))
    # "back" runs backwards and ends in a clip, so its first base is not aligned; "turned" begins in one
    assert rows(found, "qname") == [("ok",), ("turned",), ("unmapped",)]
    turned = pairs.accepted_pairs(alignments(spark, [record("t", 0x40 | 0x10, "40"), record("t", 0x80)]))
    assert rows(turned, "qname", "r1", "p1") == [("t", True, 10)]


def test_hits_are_ordered_and_distinct(spark):
    given = spark.createDataFrame([(2, 5, True, 1, 7, False), (1, 7, False, 2, 5, True), (3, 1, True, 3, 2, True)], "t1 int, p1 long, r1 boolean, t2 int, p2 long, r2 boolean")
    assert rows(pairs.distinct_hits(given), "id1", "pos1", "rev1", "id2", "pos2", "rev2") == [(1, 7, False, 2, 5, True)]
    assert pairs.distinct_hits(given, all_contacts=True).count() == 2


@pytest.mark.parametrize(("length", "middle"), [(1, True), (2, True), (3, True), (10, True), (11, False), (2_999_999, True), (7, False)])
def test_zone_borders(spark, length, middle):
    left, right = spark.range(1).select(*zone_borders(F.lit(length), middle)).first()
    assert (left, right) == ((length // 3, 2 * length // 3 + 1) if middle else (length // 2, length // 2 + 1))
    marks = spark.range(length + 1).select(zone(F.col("id"), F.lit(left), F.lit(right)).alias("z"), "id").collect() if length < 100 else []
    assert all(r["z"] == ("+" if r["id"] <= left else "-" if r["id"] >= right else None) for r in marks)


def test_contacts_within_an_end_count_twice(spark):
    contigs = spark.createDataFrame([(1, "a", 90, False)], "tid int, name string, len long, is_circ boolean")
    hit = spark.createDataFrame([(1, 5, True, 1, 6, True)], "id1 int, pos1 long, rev1 boolean, id2 int, pos2 long, rev2 boolean")
    assert rows(contacts.contact_matrix(hit, contigs), "id1", "end1", "end2", "weight", "n") == [(1, "+", "+", 2.0, 2)]
    circles = contigs.withColumn("is_circ", F.lit(True))
    assert contacts.named(contacts.contact_matrix(hit, contigs), circles).count() == 0


def test_unique_best(spark):
    both = lambda edges: [*edges, *[(c, d, a, b, w) for a, b, c, d, w in edges]]
    tied = spark.createDataFrame(both([("x", "+", "y", "-", 3.0), ("x", "+", "z", "-", 3.0)]), EDGE)
    assert matching.unique_best(tied).count() == 0
    chain = spark.createDataFrame(both([("x", "+", "y", "-", 3.0), ("y", "-", "z", "-", 4.0)]), EDGE)
    assert rows(matching.unique_best(chain), "ctg1", "ctg2") == [("y", "z"), ("z", "y")]


def test_orientation(spark):
    cells = spark.createDataFrame([("a", "b", 1.0, 5.0, 2.0, 0.0, 5.0), ("a", "c", 5.0, 5.0, 1.0, 0.0, 5.0)], "ctg1 string, ctg2 string, mm double, mp double, pm double, pp double, best double")
    assert rows(candidates.orientation(cells), "ctg2", "cell") == [("b", 1), ("c", None)]
    assert rows(candidates.oriented(cells), "ctg1", "end1", "ctg2", "end2") == [("a", "-", "b", "+")]


def test_significance_and_share(spark):
    links = spark.createDataFrame(
        [("a", "+", "b", "-", 20.0), ("a", "+", "c", "-", 2.0), ("b", "+", "c", "+", 5.0), ("b", "+", "d", "+", 4.0), ("c", "+", "d", "+", 5.0), ("c", "+", "d", "-", 5.0)], EDGE
    ).withColumns({"weight": F.col("w"), "zone2": F.lit(1)})
    ranking = weights.ranked(links)
    assert rows(weights.significant(ranking).select("ctg1").distinct(), "ctg1") == [("a",), ("c",)]
    assert rows(weights.max_share(ranking, 0.9).select("ctg1").distinct(), "ctg1") == [("a",)]
    assert rows(weights.top(ranking, 1), "ctg1", "ctg2") == [("a", "b"), ("b", "c"), ("c", "d")]


def joins(spark, *pairs_):
    return spark.createDataFrame([x for a, b, c, d in pairs_ for x in ((a, b, c, d, 1.0), (c, d, a, b, 1.0))], EDGE)


def contigs_of(spark, names, circ=()):
    return spark.createDataFrame([(n, 100, n in circ) for n in names], "name string, len long, is_circ boolean")


def walked(df):
    out = {}
    for r in df.orderBy("head", "ord").collect():
        out.setdefault((r["head"], r["is_circ"]), []).append(r["name"] + ("+" if r["fwd"] else "-"))
    return out


def test_paths(spark, any_size):
    found = chains.scaffold_elements(joins(spark, ("b", "-", "a", "-"), ("b", "+", "c", "+")), contigs_of(spark, "abcd", circ="d"))
    assert walked(found) == {("a", False): ["a+", "b-", "c+"], ("d", True): ["d+"]}
    assert rows(chains.paths_of(found), "head", "n", "len") == [("a", 3, 700), ("d", 1, 100)]


def test_circles(spark, any_size):
    found = chains.scaffold_elements(joins(spark, ("b", "-", "a", "-"), ("b", "+", "c", "+"), ("c", "-", "a", "+")), contigs_of(spark, "abc"))
    assert walked(found) == {("a", True): ["a+", "b-", "c+"]}
    turned = chains.scaffold_elements(joins(spark, ("z", "-", "y", "-"), ("z", "+", "y", "+")), contigs_of(spark, "yz"))
    assert walked(turned) == {("y", True): ["y+", "z-"]}


def test_random_paths_hold_every_contig_once(spark, any_size):
    rng = random.Random(3)
    names = [f"c{i:02d}" for i in range(40)]
    free = [(n, e) for n in names for e in "+-"]
    rng.shuffle(free)
    pairs_ = []
    while len(free) > 10:
        a, b = free.pop(), free.pop()
        if a[0] != b[0]:
            pairs_.append((*a, *b))
    found = walked(chains.scaffold_elements(joins(spark, *pairs_), contigs_of(spark, names)))
    assert sorted(x[:-1] for p in found.values() for x in p) == names
    ends = {frozenset([(a, b), (c, d)]) for a, b, c, d in pairs_}
    for (_, circ), path in found.items():
        steps = list(zip(path, path[1:], strict=False)) + ([(path[-1], path[0])] if circ else [])
        for x, y in steps:
            assert frozenset([(x[:-1], "-" if x[-1] == "+" else "+"), (y[:-1], y[-1])]) in ends


def test_nested_paths(spark):
    elements = spark.createDataFrame([("p", 1, "a", True), ("p", 2, "b", False), ("q", 1, "p", False), ("q", 2, "c", True), ("r", 1, "q", False)], "path string, ord int, name string, fwd boolean")
    roots = spark.createDataFrame([("q",), ("r",)], "root string")
    found = chains.flattened(elements, roots).orderBy("root", "ord").collect()
    assert ["".join([r["name"], "+" if r["fwd"] else "-"]) for r in found if r["root"] == "q"] == ["b+", "a-", "c+"]
    assert ["".join([r["name"], "+" if r["fwd"] else "-"]) for r in found if r["root"] == "r"] == ["c-", "a+", "b-"]
    loop = spark.createDataFrame([("p", 1, "q", True), ("q", 1, "p", True)], "path string, ord int, name string, fwd boolean")
    with pytest.raises(ValueError):
        chains.flattened(loop, roots)


def test_names_pass_over_taken_ones(spark):
    paths = spark.createDataFrame([("a", False), ("b", True)], "head string, is_circ boolean")
    taken = spark.createDataFrame([("u000000000",), ("c000000002",), ("else",)], "name string")
    assert rows(chains.named_paths(paths, taken), "head", "name") == [("a", "u000000001"), ("b", "c000000003")]


@pytest.fixture(params=["one task", "rounds"])
def any_size(request, monkeypatch):
    """Small graphs are walked by one task, others in rounds: both must give the same."""
    if request.param == "rounds":
        monkeypatch.setattr(iterate, "SMALL_GRAPH", 0)


def _kruskal(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    kept = []
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = find(a), find(b)
        if x != y:
            up[x] = y
            kept.append((a, b, w))
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_forest(spark, any_size, seed):
    rng = random.Random(seed)
    edges = {(a, b): float(rng.randint(1, 5)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.3}
    given = [(f"n{a:02d}", f"n{b:02d}", w) for (a, b), w in edges.items()]
    assert rows(forest.spanning_forest(spark.createDataFrame(given, "a string, b string, w double")), "a", "b", "w") == _kruskal(given)


def test_rounds_of_a_forest_read_contracted_graphs(spark, monkeypatch):
    """After each round at most one edge is left between two trees, and none inside one."""
    rng, seen = random.Random(6), []
    plain = forest.contracted

    def watched(left, root):
        out = plain(left, root)
        found = out.collect()
        assert len({frozenset((r["x"], r["y"])) for r in found}) == len(found) and all(r["x"] < r["y"] for r in found)
        seen.append((root.count(), root.select("up").distinct().count(), len(found)))
        return out

    monkeypatch.setattr(forest, "contracted", watched)
    edges = {(a, b): float(rng.randint(1, 50)) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3}
    given = [(f"n{a:02d}", f"n{b:02d}", w) for (a, b), w in edges.items()]
    assert rows(forest.spanning_forest(spark.createDataFrame(given, "a string, b string, w double"), 0), "a", "b", "w") == _kruskal(given)
    assert seen[-1][2] == 0 and seen[0][0] == 60 and all(after <= before // 2 for before, after, _ in seen)
    assert all(left <= trees * (trees - 1) // 2 for _, trees, left in seen) and [x[2] for x in seen] == sorted((x[2] for x in seen), reverse=True)


@pytest.mark.parametrize("scale", [1, 3])
def test_axis_map_at_all_widths(spark, scale):
    rng = random.Random(scale)
    sizes = {"s": 900, "t": 500, "u": 2000}
    start = {"u": 0, "s": 2000, "t": 2900}
    pairs_ = [(rng.choice("stu"), rng.randint(0, 499), rng.randint(0, 2), rng.choice("stu"), rng.randint(0, 499), rng.randint(0, 2)) for _ in range(400)]
    lifted = spark.createDataFrame([(f"r{i}", a, p, False, q, b, x, True, y) for i, (a, p, q, b, x, y) in enumerate(pairs_)], "qname string, s1 string, p1 long, r1 boolean, q1 int, s2 string, p2 long, r2 boolean, q2 int")
    table = spark.createDataFrame(list(sizes.items()), "scf string, len long")
    widths = (1000, 250, 100, 50)
    wanted = {}
    for a, p, q, b, x, y in pairs_:
        if q >= 1 and y >= 1:
            for w in widths:
                one, two = sorted((start[s] + at) // scale // (w // scale) for s, at in ((a, p), (b, x)))
                wanted[w, w // scale, one, two] = wanted.get((w, w // scale, one, two), 0) + 1
    found = contacts.axis_map(lifted, table, scale, widths)
    assert rows(found, "width", "bin_width", "bin1", "bin2", "n") == sorted((*k, n) for k, n in wanted.items())
    assert rows(contacts.axis_sizes(table, scale), "name", "len") == [("assembly", 3400 // scale)]


def test_zoom_pyramid_ends_with_one_bin(spark):
    assert contacts.zoom_levels(999) == [1000] and contacts.zoom_levels(1000) == [1000, 2000] and contacts.zoom_levels(70, 10, 3) == [10, 30, 90] and contacts.zoom_levels(0) == [1000]
    lifted = spark.createDataFrame([("s", 5, "s", 69), ("s", 70, "t", 3), ("t", 31, "s", 12)], "s1 string, p1 long, s2 string, p2 long")
    found = contacts.zoom_pyramid(lifted, spark.createDataFrame([("s", 70), ("t", 40)], "scf string, len long"), 10, 3)
    assert rows(found.filter("level = 0"), "width", "s1", "bin1", "s2", "bin2", "n") == [(10, "s", 0, "s", 6, 1), (10, "s", 1, "t", 3, 1), (10, "s", 7, "t", 0, 1)]
    assert rows(found.filter("level = 2"), "width", "s1", "bin1", "s2", "bin2", "n") == [(90, "s", 0, "s", 0, 1), (90, "s", 0, "t", 0, 2)]
    assert found.groupBy("level").agg(F.sum("n").alias("n")).filter("n <> 3").count() == 0 and found.select("level").distinct().count() == 3


def test_contig_forest_finds_the_best_directions(spark, any_size):
    cell = "ctg1 string, ctg2 string, mm double, mp double, pm double, pp double, best double"
    one = [("a", "b", 0.0, 9.0, 0.0, 1.0, 9.0), ("b", "c", 0.0, 0.0, 8.0, 3.0, 8.0)]  # a+ b+ gives 9, then b+ c: nothing; a+ b- gives nothing
    two = [(b, a, mm, pm, mp, pp, best) for a, b, mm, mp, pm, pp, best in one]
    found = forest.contig_forest(spark.createDataFrame(one + two, cell))
    assert ("a", "-", "b", "+", 9e6) in rows(found, "ctg1", "end1", "ctg2", "end2", "w")
    assert found.count() == 4


def test_coverage(spark):
    spans = spark.createDataFrame([("s", 2, 5), ("s", 4, 8)], "scf string, s long, e long")
    sizes = spark.createDataFrame([("s", 10), ("t", 3)], "scf string, len long")
    found = coverage.coverage(spans, sizes)
    assert rows(found, "scf", "s", "e", "cov") == [("s", 1, 1, 0), ("s", 2, 3, 1), ("s", 4, 5, 2), ("s", 6, 8, 1), ("s", 9, 10, 0), ("t", 1, 3, 0)]
    region = spark.createDataFrame([("s", 1, 3, 6)], "scf string, region int, rs long, re long")
    got = coverage.region_stats(found, region).first()
    assert (got["max_cov"], got["mean_cov"]) == (2.0, 1.5) and abs(got["sd_cov"] - (1 / 3) ** 0.5) < 1e-12
    narrow = coverage.overlaps(found, region, width=2).select("s").distinct().count()
    assert narrow == coverage.overlaps(found, region, width=2).count() == 3
    assert rows(coverage.histogram(found, 1), "cov", "bases") == [(0, 6), (1, 7)]
    assert rows(coverage.supported(found, 1, 1), "s", "e") == [(2, 8)]
    assert rows(coverage.supported(found, 1, 1, distance=2), "s", "e") == [(2, 3), (6, 8)]
    assert rows(coverage.wig_windows(found.filter("scf = 's'"), sizes, width=4), "start", "span", "cov") == [(1, 4, 1), (5, 6, 0)]
    assert rows(coverage.column_maxima(found.filter("scf = 's'"), 4, 2), "window", "col", "max_cov") == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (2, 0, 0)]


def test_breaks(spark):
    stats = spark.createDataFrame([("s", i + 1, float(x)) for i, x in enumerate([100, 20, 80, 60, 90])], "scf string, region int, max_cov double")
    assert rows(breaks.break_calls(stats, 0.3), "scf", "ord") == [("s", 1)]
    elements = spark.createDataFrame([("s", i, n, 100) for i, n in ((1, "a"), (2, "b"), (3, "c"))], "scf string, ord int, name string, len long")
    assert rows(breaks.pieces(elements, breaks.break_calls(stats, 0.3)), "piece", "n", "len", "first", "last") == [(0, 1, 100, "a", "a"), (1, 2, 400, "b", "c")]
    empty = stats.withColumn("max_cov", F.lit(0.0))
    assert breaks.break_calls(empty, 0.3).count() == 0


def test_metrics(spark):
    got = metrics.assembly_metrics(spark.createDataFrame([(500,), (300,), (200,)], "len long")).first()
    assert (got["n"], got["total"], got["longest"], got["n50"]) == (3, 1000, 500, 500)
    same = metrics.assembly_metrics(spark.createDataFrame([(10,)] * 5, "len long")).first()
    assert (same["n"], same["n50"]) == (5, 10)
    assert metrics.assembly_metrics(spark.createDataFrame([], "len long")).first()["n"] == 0


def test_sequences(spark):
    turned = spark.createDataFrame([("ACGTN",), ("acg",), ("RYK",)], "s string").select(reverse_complement(F.col("s")).alias("t"))
    assert [r["t"] for r in turned.collect()] == ["NACGT", "CGT", "MRY"]
    elements = spark.createDataFrame([("s", 2, "b", False), ("s", 1, "a", True), ("t", 1, "none", True)], "scf string, ord int, name string, fwd boolean")
    given = spark.createDataFrame([("a", "AC"), ("b", "AAG")], "name string, seq string")
    found = sequences.scaffold_sequences(elements, given)
    assert rows(found, "scf", "len", "seq") == [("s", 205, "AC" + "N" * 200 + "CTT")]
    assert sequences.scaffold_sequences(elements, given, min_length=206).count() == 0
    assert "".join(r["part"] for r in sequences.sequence_pieces(elements, given).orderBy("scf", "ord").collect()) == "AC" + "N" * 200 + "CTT"


def test_molecules(spark):
    hits = spark.createDataFrame([("b", "s", p, 30) for p in (100, 900, 2000, 50_000, 50_100)] + [("b", "t", 2100, 30)], "bc string, scf string, pos long, mapq int")
    found = molecules.molecules(hits, max_span=20_000, min_barcode=1, min_members=2, min_length=1000, min_mean_mapq=20)
    assert rows(found, "bc", "scf", "s", "e", "n", "mean_mapq") == [("b", "s", 100, 2000, 3, 30)]
    assert molecules.molecules(hits, min_barcode=6, min_members=1).count() == 0


def test_one_axis(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 9)], "scf string, len long")
    assert rows(contacts.axis(sizes), "scf", "start") == [("a", 9), ("b", 0)]
    assert contacts.axis_scale(sizes) == 1 and contacts.axis_scale(sizes.withColumn("len", F.lit(2_000_000_000))) == 2
    lifted = spark.createDataFrame([("q", "b", 3, True, 1, 30, "a", 2, False, 1, 40)], "qname string, s1 string, p1 long, r1 boolean, ord1 int, q1 int, s2 string, p2 long, r2 boolean, ord2 int, q2 int")
    assert rows(contacts.on_axis(lifted, sizes, 2), "x1", "strand1", "q1", "x2", "strand2", "q2") == [(5, 0, 40, 1, 1, 30)]


def test_linked_reads(spark):
    """Molecules that cross a gap keep a path whole; where none does it is cut."""
    from dataclasses import replace

    from strandloom.plans import scaffolding

    contigs = spark.createDataFrame([(1, "a", 5000), (2, "b", 5000), (3, "c", 5000)], "tid int, name string, len long")
    graph = scaffolding.first_graph(contigs)
    elems = [("u000000000", 15_400, False, [("a", True), ("b", True), ("c", True)])]
    paths = spark.createDataFrame(elems, "name string, len long, is_circ boolean, elems array<struct<name: string, fwd: boolean>>")
    graph = scaffolding.with_assembly(replace(graph, paths=paths), paths.select("name"))
    hits = [(f"m{i}", 1, p, 40) for i in range(10) for p in (2000, 3000, 4000)] + [(f"m{i}", 2, p, 40) for i in range(10) for p in (500, 1500)] + [(f"n{i}", 3, p, 40) for i in range(10) for p in (500, 1500, 2500)]
    found = scaffolding.break_by_molecules(spark.createDataFrame(hits, "bc string, scf int, pos long, mapq int"), contigs, graph, min_barcode=1, min_members=1, min_length=100, min_mean_mapq=5)
    assert rows(found.calls, "scf", "ord") == [("u000000000", 2)]
    assert rows(found.graph.current_sizes(), "len") == [(5000,), (10_200,)]
    links = spark.createDataFrame([("a", "-", "b", "+", 50.0, 100, 100, 50), ("b", "+", "a", "-", 50.0, 100, 100, 50)], "ctg1 string, end1 string, ctg2 string, end2 string, weight double, zone2 long, zone1 long, n long")
    assert rows(scaffolding.joins_by_barcodes(links), "ctg1", "ctg2", "w") == [("a", "b", 0.5), ("b", "a", 0.5)]
    assert rows(weights.per_zone_pair(links), "w") == [(500.0,), (500.0,)]


def test_sweep_by_bins_is_the_plain_one(spark):
    """Coverage and supported regions by brute force, with bins that spans and gaps cross."""
    rng = random.Random(12)
    lengths = {"a": 300, "b": 70, "c": 1}
    spans = [(x, s, min(lengths[x], s + rng.randint(0, 60))) for x in "aab" for _ in range(12) for s in [rng.randint(1, lengths[x])]]
    table = spark.createDataFrame(spans, "scf string, s long, e long")
    scaffolds = spark.createDataFrame(list(lengths.items()), "scf string, len long")
    base = {x: [sum(s <= i <= e for y, s, e in spans if y == x) for i in range(1, n + 1)] for x, n in lengths.items()}
    for width in (7, 64, 1 << 20):
        found = coverage.coverage(table, scaffolds, width)
        tiles = {x: [] for x in lengths}
        for x, s, e, cov in sorted(rows(found, "scf", "s", "e", "cov")):
            assert s == len(tiles[x]) + 1 and e >= s
            tiles[x] += [cov] * (e - s + 1)
        assert tiles == base
        want = []
        for x, values in base.items():
            for i, v in enumerate(values, 1):
                if 1 <= v <= 3:
                    if want and want[-1][0] == x and i - want[-1][2] < 5:
                        want[-1][2] = i
                    else:
                        want.append([x, i, i])
        assert rows(coverage.supported(found, 1, 3, 5, width), "scf", "s", "e") == sorted(map(tuple, want))


def test_numbers_and_sums_over_range_partitions(spark):
    rng = random.Random(5)
    values = [(i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 500)]
    found = iterate.running(spark.createDataFrame(values, "k long, v long").repartition(7), [F.desc("k")], F.col("v"))
    total, want = 0, []
    for k, v in sorted(values, reverse=True):
        want.append((k, v, total))
        total += v
    assert rows(found, "k", "v", "before") == sorted(want)
    assert iterate.running(spark.createDataFrame([], "k long"), [F.col("k")], F.lit(1)).count() == 0


def test_significant_ends(spark):
    links = [("x", "+", "y", "-", 30.0, 1), ("x", "+", "z", "-", 5.0, 2), ("x", "-", "y", "+", 10.0, 1), ("x", "-", "z", "+", 9.0, 2), ("z", "+", "y", "-", 10.0, 1), ("z", "+", "y", "+", 9.0, 2), ("y", "+", "x", "-", 1.0, 1)]
    ranking = spark.createDataFrame(links, "ctg1 string, end1 string, ctg2 string, end2 string, weight double, rank int")
    assert set(rows(weights.significant(ranking, 0.95), "ctg1", "end1")) == {("x", "+"), ("z", "+"), ("y", "+")}


def test_misplaced_elements(spark):
    """Four contigs in a row: the third has its contacts with one that lies elsewhere."""
    placed = spark.createDataFrame([("s", i, i, True, 100, i == 1, i == 4) for i in range(1, 5)], "scf string, ord int, tid int, fwd boolean, len long, is_head boolean, is_tail boolean")

    def cells(pairs_):
        out = []
        for a, b, n in pairs_:  # the right end of a meets the left end of b
            out += [(a, b, 0.0, n, 0.0, 0.0), (b, a, 0.0, 0.0, n, 0.0)]
        return spark.createDataFrame(out, "tid1 int, tid2 int, mm double, mp double, pm double, pp double")

    cut = lambda pairs_: rows(breaks.misplacements(cells(pairs_), placed), "ord")
    assert cut([(1, 2, 50.0), (2, 3, 50.0), (3, 4, 50.0)]) == []
    # the second contig's tail meets the fourth first, and clearly
    assert (2,) in cut([(1, 2, 50.0), (2, 4, 80.0), (2, 3, 5.0), (3, 4, 50.0)])
    # without any contact a contig is cut off on both sides
    assert cut([(1, 2, 50.0)]) == [(2,), (3,)]


def test_clear_joins_need_more_hits(spark):
    edges = [("a", "+", "b", "-", 2.0, 9.0), ("a", "+", "c", "-", 1.0, 8.0), ("b", "-", "a", "+", 2.0, 9.0), ("c", "-", "a", "+", 1.0, 8.0), ("d", "+", "e", "-", 2.0, 40.0), ("d", "+", "f", "-", 1.0, 3.0), ("e", "-", "d", "+", 2.0, 40.0)]
    table = spark.createDataFrame(edges, EDGE + ", hits double")
    assert rows(matching.unique_best(table), "ctg1", "ctg2") == [("a", "b"), ("b", "a"), ("d", "e"), ("e", "d")]
    assert rows(matching.unique_best(table, 0.95, "hits"), "ctg1", "ctg2") == [("d", "e"), ("e", "d")]


def test_accurate_orientation(spark):
    cells = [("a", "b", 9.0, 1.0, 0.0, 0.0, 90.0, 9.0, 1), ("a", "c", 9.0, 8.0, 0.0, 0.0, 9.0, 9.0, 1), ("a", "d", 9.0, 1.0, 0.0, 0.0, 90.0, 9.0, 2), ("a", "e", 5.0, 5.0, 0.0, 0.0, 5.0, 5.0, 1)]
    table = spark.createDataFrame(cells, "ctg1 string, ctg2 string, mm double, mp double, pm double, pp double, hits double, best double, rank int")
    assert rows(candidates.orientation(table).fillna(-1), "ctg2", "cell") == [("b", 0), ("c", 0), ("d", 0), ("e", -1)]
    assert rows(candidates.orientation(table, 0.95).fillna(-1), "ctg2", "cell") == [("b", 0), ("c", -1), ("d", -1), ("e", -1)]
