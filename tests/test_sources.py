"""Files written by the tests and read back."""

from __future__ import annotations

import gzip
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import pairs
from strandloom.plans import scaffolding
from strandloom.sources import agp, bam, fasta, sat, text, tracks

from .test_operators import rows

SAT = """H\tVN:Z:0.1
S\ta\t1000\t*
S\tb\t500\t*
S\tc\t300\tACGT
P\tu000000000\t1700\ta+,b-
P\tu000000001\t300\tc+
P\tc000000002\t2200\tu000000000-,c+
L\tb\t-\ta\t-\twt:f:0.010000
X\tignored
A\ta00000\t2\tu000000000,u000000001
A\ta00001\t1\tc000000002
C\ta00000
"""


def lines(path) -> list[str]:
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().split("\n") if x]


def bgzf(data: bytes, size: int = 60_000) -> bytes:
    """Blocks of compressed data, and the empty one at the end."""
    out = b""
    for i in range(0, len(data) + size, size):
        chunk = data[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(chunk) + c.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(chunk), len(chunk))
        if not chunk:
            break
    return out


def bam_bytes(targets, records) -> bytes:
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(targets))
    for name, length in targets:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for qname, flag, tid, pos, mapq, cigar in records:
        seq = 8
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(qname) + 1, mapq, 0, len(cigar), flag, seq, -1, -1, 0) + qname.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + b"\x11" * (seq // 2) + b"\xff" * seq
        body += b"NMC\x05" + b"RGZgroup\0" + b"XBBs\x02\x00\x00\x00\x01\x00\xff\xff"[:3] + struct.pack("<ci2h", b"s", 2, 1, -1)
        out += struct.pack("<i", len(body)) + body
    return out


def sample(n: int):
    return [(f"read{i // 2}", 0x40 if i % 2 == 0 else 0x80, i % 2, 10 * i, 30, [(0, 8)] if i % 3 else [(4, 2), (0, 6)]) for i in range(n)]


@pytest.mark.parametrize("size", [60_000, 700])
def test_bam(spark, tmp_path, size):
    records = sample(500)
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("one", 9000), ("two", 8000)], records), size))
    assert rows(bam.read_bam(spark, str(tmp_path / "x.bam"), kind="targets"), "tid", "name", "len") == [(0, "one", 9000), (1, "two", 8000)]
    for width in (1 << 26, 5_000, 1):
        found = bam.read_bam(spark, str(tmp_path), rangeBytes=str(width))
        got = bam.renumbered(found).orderBy("rec_no").collect()
        assert [r["rec_no"] for r in got] == list(range(500))
        assert [(r["qname"], r["flag"], r["tid"], r["pos0"], r["mapq"], [(c["op"], c["len"]) for c in r["cigar"]]) for r in got] == records
    assert got[0]["tags"] == {"NM": "5", "RG": "group", "XB": "1,-1"}
    bam.to_parquet(spark, str(tmp_path / "x.bam"), str(tmp_path / "p"), rangeBytes="5000")
    accepted = pairs.accepted_pairs(pairs.from_records(bam.from_parquet(spark, str(tmp_path / "p"))))
    assert accepted.count() == sum(i % 3 > 0 and (i + 1) % 3 > 0 for i in range(0, 500, 2))


def read_by(reader, filters):
    """What filters the reader leaves to Spark, and its batches."""
    left = list(reader.pushFilters(filters))
    return left, [b for part in reader.partitions() for b in reader.read(part)]


@pytest.mark.parametrize("width", [1 << 26, 1])
def test_filters_go_down_to_the_records(tmp_path, monkeypatch, width):
    """Only records that pass are decoded beyond their fixed fields, and only the columns asked for."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

    records = sample(500)
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("one", 9000), ("two", 8000)], records), 700))
    decoded = {"_names": 0, "_cigars": 0, "_tag_places": 0}
    for name in decoded:
        plain = getattr(bam.Decoder, name)

        def counted(*args, name=name, plain=plain):
            decoded[name] += len(args[1])
            return plain(*args)

        monkeypatch.setattr(bam.Decoder, name, staticmethod(counted))
    reader = lambda columns, tests=(): bam.BamReader([str(tmp_path / "x.bam")], False, width, columns, list(tests))
    other = StringContains(("qname",), "read1")
    left, batches = read_by(reader(list(bam.RECORD_FIELDS)), [EqualTo(("tid",), 1), IsNotNull(("tid",)), GreaterThan(("pos0",), 100), LessThanOrEqual(("pos0",), 1000), other])
    wanted = [i for i, r in enumerate(records) if r[2] == 1 and 100 < r[3] <= 1000]
    assert left == [other] and [x for b in batches for x in b.column("pos0").to_pylist()] == [records[i][3] for i in wanted]
    assert decoded == {"_names": len(wanted), "_cigars": len(wanted), "_tag_places": len(wanted)} and len(wanted) == 45
    assert [x for b in batches for x in b.column("qname").to_pylist()] == [records[i][0] for i in wanted]
    if width > 1:
        assert [x for b in batches for x in b.column("rec_no").to_pylist()] == wanted  # numbers count what is passed over too
    left, batches = read_by(reader(["flag", "mapq"], [("flag", "with", 0x80), ("flag", "without", 1)]), [In(("pos0",), (10, 20, 30, None))])
    assert [b.column_names for b in batches if len(b)] == [["flag", "mapq"]] * (1 if width > 1 else len([b for b in batches if len(b)])) and sum(map(len, batches)) == 2 and not left
    assert sum(decoded.values()) == 3 * len(wanted)  # no names, no CIGARs, no tags for these


def test_pushed_filters_and_columns_in_plans(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("one", 9000), ("two", 8000)], sample(500)), 700))
    found = bam.read_bam(spark, str(tmp_path), columns="pos0, tid,qname").filter("tid = 1 and pos0 > 100 and qname like '%7'")
    assert found.columns == ["qname", "tid", "pos0"]
    assert rows(found, "pos0") == [(10 * i,) for i in range(500) if i % 2 == 1 and 10 * i > 100 and f"{i // 2}".endswith("7")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    tested = [x for x in plan.splitlines() if "Filter (" in x]
    assert any("qname" in x for x in tested) and not any("tid" in x for x in tested)  # the reader has tested that


def test_bam_is_written_as_read(spark, tmp_path):
    given = [("r\u00e9ad", 0x40, 0, 5, 30, [{"op": 0, "len": 8}], {"BX": "ACGT", "XX": ""}, 1, 7, -3), ("b" * 200, 0x84, -1, -1, 0, [], {}, -1, -1, 0), ("c", 0x14, 1, 1 << 28, 255, None, None, None, None, None)]
    schema = "qname string, flag int, tid int, pos0 int, mapq smallint, cigar array<struct<op: tinyint, len: int>>, tags map<string, string>, mate_tid int, mate_pos int, isize int"
    targets = spark.createDataFrame([(1, "two", 8000), (0, "one", 9000)], "tid int, name string, len long")
    many = spark.createDataFrame(given * 2000, schema)
    bam.write_bam(many.repartition(3), targets, str(tmp_path / "out"))
    bam.write_bam(many.limit(0), targets, str(tmp_path / "none"))
    found = bam.read_bam(spark, str(tmp_path / "out"))
    filled = [tuple(y if y is not None else other for y, other in zip(x, ("*", 4, -1, -1, 255, [], {}, -1, -1, 0), strict=True)) for x in given]
    got = found.groupBy(*[c for c in schema.replace(",", "").split() if c in ("qname", "flag", "tid", "pos0", "mapq", "mate_tid", "mate_pos", "isize")], "cigar", F.to_json("tags").alias("tags")).count().collect()
    assert len(got) == 3 and {r["count"] for r in got} == {2000}
    for x in filled:
        assert any(r["qname"] == x[0] and r["flag"] == x[1] and (r["tid"], r["pos0"], r["mapq"], r["mate_tid"], r["mate_pos"], r["isize"]) == (x[2], x[3], x[4], *x[7:]) and [c.asDict() for c in r["cigar"]] == x[5] for r in got)
    assert set(rows(bam.read_bam(spark, str(tmp_path / "none"), kind="targets"), "tid", "name", "len")) == {(0, "one", 9000), (1, "two", 8000)}
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_broken_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("one", 9000)], sample(3))[:-3]))
    with pytest.raises(Exception, match="cut off"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).count()
    (tmp_path / "x.bam").write_bytes(bgzf(b"nothing of the kind"))
    with pytest.raises(Exception, match="not a BAM"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).count()


def test_targets_of_files_are_matched_by_name(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("two", 8000), ("one", 9000)], sample(4))))
    contigs = spark.createDataFrame([(7, "one"), (8, "two")], "tid int, name string")
    found = bam.by_name(bam.read_bam(spark, str(tmp_path / "x.bam")), bam.read_bam(spark, str(tmp_path / "x.bam"), kind="targets"), contigs)
    assert [r["tid"] for r in found.orderBy("rec_no").collect()] == [8, 7, 8, 7]


def test_several_files_with_other_orders_of_contigs(spark, tmp_path):
    """Files list their contigs in different orders; converted ones are mapped by name as well, and all files are read."""
    names, lengths = ["one", "two", "three"], {"one": 9000, "two": 8000, "three": 7000}
    for k, order in enumerate((["three", "one", "two"], ["two", "three", "one"])):
        records = []
        for i in range(20):
            for flag, name, pos in ((0x40, "one", 8900 - i * 7 - k), (0x80, "two", 10 + i * 5 + k)):
                records.append((f"f{k}r{i}", flag, order.index(name), pos, 40, [(0, 8)]))
        (tmp_path / f"x{k}.bam").write_bytes(bgzf(bam_bytes([(n, lengths[n]) for n in order], records), 900))
    (tmp_path / "x.fai").write_text("".join(f"{n}\t{lengths[n]}\t{i}\n" for i, n in enumerate(names)))
    files = [str(tmp_path / f"x{k}.bam") for k in (0, 1)]
    columns = ["ctg1", "end1", "ctg2", "end2", "weight"]

    def linked(*reads):
        cli.main(["link", "-o", str(tmp_path / "m"), "-x", str(tmp_path / "x.fai"), *reads])
        return rows(text.read_links(spark, str(tmp_path / "m")), *columns)

    want = [("one", "-", "two", "+", 40.0), ("two", "+", "one", "-", 40.0)]
    assert linked(*files) == want
    cli.main(["convert-bam", "-o", str(tmp_path / "both"), *files])
    cli.main(["convert-bam", "-o", str(tmp_path / "first"), files[0]])
    assert linked(str(tmp_path / "both")) == want == linked(str(tmp_path / "first"), files[1])
    (tmp_path / "x.fai").write_text("one\t9000\t0\nthree\t7000\t1\n")
    with pytest.raises(Exception, match="not in the list: two"):
        linked(files[0])


def test_sat_round_trip(spark, tmp_path):
    (tmp_path / "g.sat").write_text(SAT)
    graph = sat.read_sat(spark, str(tmp_path / "g.sat"))
    assert rows(graph.paths, "name", "len", "is_circ") == [("c000000002", 2200, True), ("u000000000", 1700, False), ("u000000001", 300, False)]
    assert rows(graph.current_sizes(), "name", "len") == [("u000000000", 1700), ("u000000001", 300)]
    assert rows(sat.both_ways(graph.joins), "v", "v_end", "w", "w_end") == [("a", "-", "b", "-"), ("b", "-", "a", "-")]
    from dataclasses import replace

    sat.write_sat(replace(graph, joins=sat.both_ways(graph.joins)), str(tmp_path / "out"))
    wanted = [x for x in SAT.split("\n") if x and x[0] != "X"]
    got = lines(tmp_path / "out")
    assert sorted(got) == sorted(x.replace("L\tb\t-\ta\t-", "L\ta\t-\tb\t-") for x in wanted) and [x[0] for x in got] == list("HSSSPPPLAAC")
    flat = scaffolding.current_placement(replace(graph, current=spark.createDataFrame([("a00001",)], "name string")))
    assert [(r["name"], r["fwd"], r["off"]) for r in flat.orderBy("ord").collect()] == [("b", True, 0), ("a", False, 700), ("c", True, 1900)]
    assert sat.gfa_lines(graph).filter("value like 'A%'").count() == 0


def test_maps_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.iterate, "clear", lambda _: None)
    contacts_ = [(f"r{i}", flag, tid, 90 * i, 30, [(0, 8)]) for i in range(80) for flag, tid in ((0x40, 0), (0x80, i % 2))]
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("one", 9000), ("two", 8000)], contacts_), 900))
    cli.main(["maps", "-o", str(tmp_path / "out"), str(tmp_path / "x.bam")])
    zooms, axis = (spark.read.parquet(str(tmp_path / "out" / x)) for x in ("zooms.parquet", "axis.parquet"))
    assert rows(zooms.groupBy("level", "width").agg(F.sum("n").alias("n")), "level", "width", "n") == [(k, 1000 << k, 80) for k in range(5)]
    assert rows(zooms.filter("level = 4"), "s1", "s2", "n") == [("one", "one", 40), ("one", "two", 40)]
    assert {r["n"] for r in axis.groupBy("width").agg(F.sum("n").alias("n")).collect()} == {80} and axis.select("width").distinct().count() == 10
    assert lines(tmp_path / "out" / "assembly.sizes") == ["assembly 17000"]
    (tmp_path / "g.sat").write_text(SAT + "S\ta\t7\t*\n")
    cli.main(["conflicts", "-o", str(tmp_path / "found"), "-s", str(tmp_path / "g.sat")])
    assert lines(tmp_path / "found") == ["ignored\tS\ta\t7\t*"]


def test_conflicting_lines_of_a_graph(spark, tmp_path):
    again = "S\ta\t1000\tACGT\nS\ta\t7\t*\nS\tc\t0\tTTTT\nP\tu000000001\t1\tb+\nP\tu000000001\t300\tc+\nA\ta00001\t1\tu000000001\nL\tb\t-\ta\t-\twt:f:0.5\n"
    (tmp_path / "g.sat").write_text(SAT + again)
    found = sat.conflicts(spark, str(tmp_path / "g.sat"))
    assert rows(found, "tag", "name", "ignored") == [("A", "a00001", "A\ta00001\t1\tu000000001"), ("P", "u000000001", "P\tu000000001\t1\tb+"), ("P", "u000000001", "P\tu000000001\t300\tc+"), ("S", "a", "S\ta\t7\t*"), ("S", "c", "S\tc\t0\tTTTT")]
    graph = sat.read_sat(spark, str(tmp_path / "g.sat"))
    assert rows(graph.sequences.fillna("*"), "name", "len", "seq")[0] == ("a", 1000, "ACGT") and graph.paths.count() == 3
    (tmp_path / "clean.sat").write_text(SAT)
    assert sat.conflicts(spark, str(tmp_path / "clean.sat")).count() == 0


def test_lines_in_parts_keep_their_order(spark, tmp_path):
    """Files are written by ranges of lines; read again, lines are numbered as they stand, whatever the sizes of the files."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        given = spark.range(3000).select((F.col("id") % 3).cast("int").alias("section"), F.format_string("%06d", "id").alias("ord"), F.concat(F.format_string("%d %06d ", F.col("id") % 3, "id"), F.repeat(F.lit("x"), F.expr("cast(id % 40 as int)"))).alias("value"))
        text.write_lines(given, str(tmp_path / "out"))
        assert len(list((tmp_path / "out").glob("part-*"))) > 1
        wanted = sorted(r["value"] for r in given.collect())
        assert lines(tmp_path / "out") == wanted
        found = text.numbered_lines(text.read_lines(spark, str(tmp_path / "out")))
        assert [r["value"] for r in found.orderBy("number").collect()] == wanted and {r["number"] for r in found.collect()} == set(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_fai_links_and_tracks(spark, tmp_path):
    (tmp_path / "x.fai").write_text("b\t10\t100\t60\t61\na\t20\t3\n\n")
    assert rows(text.contigs(text.read_fai(spark, str(tmp_path / "x.fai"))), "tid", "name", "len") == [(0, "a", 20), (1, "b", 10)]
    with gzip.open(tmp_path / "x.mat.gz", "wt") as f:
        f.write("a\t+\tb\t-\t3.500000\t5\t6\t4\na\t+\tb\nb\t-\ta\t+\t2\n")
    links = text.read_links(spark, str(tmp_path / "x.mat.gz"))
    assert rows(links, "ctg1", "end2", "weight", "zone2", "n") == [("a", "-", 3.5, 5, 4), ("b", "+", 2.0, 0, 0)]
    text.write_links(links, str(tmp_path / "out"))
    assert rows(text.read_links(spark, str(tmp_path / "out")), *links.columns) == rows(links, *links.columns)
    (tmp_path / "t.bed").write_text('browser position x\ntrack name="n" description="some words"\nc\t1\t2\nd\t3\n')
    assert rows(text.read_track(spark, str(tmp_path / "t.bed")), "name", "s", "e", "f4") == [("c", 1, 2, 0), ("d", 3, 0, 0)]
    assert text.track_header(spark, str(tmp_path / "t.bed")).first() == ("n", "some words")


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a some words\nAC\nGT\n>b\r\nTT\r\n\n>a\nAAAA\n>c\n")
    found = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert rows(found, "name", "seq") == [("a", "ACGT"), ("b", "TT"), ("c", "")]
    filled = fasta.with_sequences(spark.createDataFrame([("a", 0, None), ("b", 7, None), ("z", 0, None)], "name string, len long, seq string"), found)
    assert rows(filled, "name", "len") == [("a", 4), ("b", 7), ("z", 0)]
    fasta.write_fasta(found, str(tmp_path / "out"), min_length=3)
    assert lines(tmp_path / "out") == [">a 4", "ACGT"]


def test_pieces_bedgraph_gfa_and_repeated_sequences(spark, tmp_path):
    (tmp_path / "g.sat").write_text(SAT.replace("S\ta\t1000\t*\n", "S\ta\t0\t*\nS\ta\t1000\t*\nS\ta\t7\tACGT\n"))
    assert rows(sat.read_sat(spark, str(tmp_path / "g.sat")).sequences.fillna("*"), "name", "len", "seq") == [("a", 1000, "ACGT"), ("b", 500, "*"), ("c", 300, "ACGT")]
    graph = sat.read_gfa(spark, str(tmp_path / "g.sat"))
    assert (graph.paths.count(), graph.joins.count(), graph.assemblies.count(), graph.current.count()) == (3, 1, 0, 0)
    assert scaffolding.current_sequences(graph).count() == 3
    (tmp_path / "x.fa").write_text(">a\nAACC\n>b\nGG\n>c\nT\n")
    cli.main(["gets", "-o", str(tmp_path / "out"), "-s", str(tmp_path / "g.sat"), "-c", str(tmp_path / "x.fa"), "--pieces"])
    assert lines(tmp_path / "out") == [">u000000000", "AACC", "N" * 200 + "CC", ">u000000001", "T"]
    intervals = spark.createDataFrame([("s", 5, 9, 2), ("s", 1, 4, 1), ("t", 1, 3, 0)], "scf string, s long, e long, cov long")
    tracks.write_bedgraph(intervals, str(tmp_path / "bg"))
    assert lines(tmp_path / "bg") == ["s\t1\t4\t1", "s\t5\t9\t2", "t\t1\t3\t0"]


def test_agp(spark, tmp_path):
    (tmp_path / "x.agp").write_text("# made up\ns2\t1\t10\t1\tW\tb\t1\t10\t+\ns2\t11\t210\t2\tN\t200\tscaffold\tyes\tx\ns2\t211\t230\t3\tW\ta\t1\t20\t-\ns1\t1\t5\t1\tW\tc\t1\t5\t+\n")
    found = agp.read_agp(spark, str(tmp_path / "x.agp"))
    assert rows(found, "number", "object", "comp", "len", "orient") == [(1, "s2", "b", 10, "+"), (2, "s2", "a", 20, "-"), (3, "s1", "c", 5, "+")]
    agp.write_assembly(found, str(tmp_path / "out"))
    assert lines(tmp_path / "out") == [">b 1 10", ">a 2 20", ">c 3 5", "1 -2", "3"]
    placed = spark.createDataFrame([("s", 1, "a", 5, True, 0, False), ("s", 2, "b", 6, False, 205, True)], "scf string, ord int, name string, len long, fwd boolean, off long, is_tail boolean")
    got = [r["value"].split("\t") for r in agp.agp_lines(placed).orderBy("part").collect()]
    assert [x[1:6] for x in got] == [["1", "5", "1", "W", "a"], ["6", "205", "2", "N", "200"], ["206", "211", "3", "W", "b"]]


def test_wig(spark, tmp_path):
    windows = spark.createDataFrame([("s", 1, 4, 1), ("s", 5, 4, 2), ("s", 9, 6, 3), ("t", 1, 5, 0)], "scf string, start long, span long, cov long")
    tracks.write_wig(windows, str(tmp_path / "out"), "HIC", width=4)
    assert lines(tmp_path / "out") == ['track type="wiggle_0" name="HIC"', "fixedStep chrom=s start=1 step=4 span=4", "1", "2", "variableStep chrom=s span=6", "9 3", "variableStep chrom=t span=5", "1 0"]
    assert rows(tracks.read_wig(spark, str(tmp_path / "out")), "scf", "s", "span", "cov") == [("s", 1, 4, 1), ("s", 5, 4, 2), ("s", 9, 6, 3), ("t", 1, 5, 0)]


def test_scaffolding_from_files(spark, tmp_path, monkeypatch):
    """Two contigs whose ends meet are joined, and a long way from any contact they are not cut."""
    import random

    rng = random.Random(1)
    records = []
    for i in range(60):
        for flag, tid, pos in ((0x40, 0, 8000 + rng.randrange(900)), (0x80, 1, rng.randrange(900))):
            records.append((f"r{i}", flag, tid, pos, 40, [(0, 8)]))
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes([("one", 9000), ("two", 9000), ("three", 9000)], records), 900))
    (tmp_path / "x.fa").write_text(">one\n" + "A" * 9000 + "\n>two\n" + "C" * 9000 + "\n>three\n" + "G" * 9000 + "\n")
    out = tmp_path / "out"
    cli.main(["scaffold", "-o", str(out), "-w", "5", "-k", "1", "-i", "2", "-r", str(tmp_path / "x.fa"), str(tmp_path / "x.bam")])
    graph = sat.read_sat(spark, str(out / "scaffolds.sat"))
    assert sorted(r["len"] for r in graph.current_sizes().collect()) == [9000, 18_200]
    found = fasta.read_fasta(spark, str(out / "scaffolds_final.fa"))
    assert sorted(r["n"] for r in found.select(F.length("seq").alias("n")).collect()) == [9000, 18_200]
    cli.main(["link", "-o", str(tmp_path / "m"), str(tmp_path / "x.bam")])
    links = text.read_links(spark, str(tmp_path / "m"))
    assert rows(links, "ctg1", "end1", "ctg2", "end2") == [("one", "-", "two", "+"), ("two", "+", "one", "-")]
    (tmp_path / "x.fai").write_text("one\t9000\t0\ntwo\t9000\t1\nthree\t9000\t2\n")
    cli.main(["build", "-o", str(tmp_path / "b"), "-x", str(tmp_path / "x.fai"), "-w", "5", str(tmp_path / "m")])
    assert sat.read_sat(spark, str(tmp_path / "b")).current_sizes().count() == 2
    (tmp_path / "x.fai").write_text("one\t9000\t0\n")
    with pytest.raises(ValueError, match="two"):
        cli.main(["build", "-o", str(tmp_path / "b"), "-x", str(tmp_path / "x.fai"), str(tmp_path / "m")])


def plain_record(row: dict) -> bytes:
    """A record written field by field."""
    get = lambda key, other: other if row[key] is None else row[key]
    name, cigar = get("qname", "*").encode("latin-1") + b"\0", get("cigar", [])
    tags = b"".join(k.encode("latin-1") + b"Z" + v.encode("latin-1") + b"\0" for k, v in get("tags", []))
    fixed = struct.pack("<iiBBHHHiiii", get("tid", -1), get("pos0", -1), len(name), get("mapq", 255), 4680, len(cigar), get("flag", 4), 0, get("mate_tid", -1), get("mate_pos", -1), get("isize", 0))
    data = fixed + name + b"".join(struct.pack("<I", x["len"] << 4 | x["op"]) for x in cigar) + tags
    return struct.pack("<i", len(data)) + data


def random_records(n: int) -> pa.RecordBatch:
    r = random.Random(7)
    maybe = lambda f: None if r.random() < 0.1 else f()
    text_ = lambda most: "".join(r.choice("abcXYZ09éÿ" if r.random() < 0.02 else "abcXYZ09") for _ in range(r.randrange(most)))
    made = [
        {
            "qname": maybe(lambda: text_(100)), "flag": maybe(lambda: r.randrange(1 << 16)), "tid": maybe(lambda: r.randrange(-1, 9)), "pos0": maybe(lambda: r.randrange(-1, 1 << 31)), "mapq": maybe(lambda: r.randrange(256)),
            "cigar": maybe(lambda: [{"op": r.randrange(9), "len": r.randrange(1 << 28)} for _ in range(r.randrange(5))]), "mate_tid": maybe(lambda: r.randrange(-1, 9)), "mate_pos": maybe(lambda: 5), "isize": maybe(lambda: -7),
            "tags": maybe(lambda: [(k, text_(20)) for k in r.sample(["BX", "RV", "XX"], r.randrange(4))]),
        }
        for _ in range(n)
    ]
    types = {"qname": pa.string(), "flag": pa.int32(), "tid": pa.int32(), "pos0": pa.int32(), "mapq": pa.int16(), "cigar": pa.list_(pa.struct([("op", pa.int8()), ("len", pa.int32())])), "mate_tid": pa.int32(), "mate_pos": pa.int32(), "isize": pa.int32(), "tags": pa.map_(pa.string(), pa.string())}
    return pa.RecordBatch.from_pylist(made, pa.schema(list(types.items())))


def test_records_are_written_by_arrays():
    """The same bytes as one by one, nulls and parts of batches included, at a small part of the time that takes."""
    batch = random_records(3000)
    for part in (batch, batch.slice(100, 7), batch.slice(0, 0)):
        assert bytes(bam.records_bytes(part)) == b"".join(map(plain_record, part.to_pylist()))
    began = time.process_time()
    for _ in range(20):
        bam.records_bytes(batch)
    assert time.process_time() - began < 20 * 3000 * 10e-6  # one by one some 50 us each
    for field, value in (("flag", 1 << 16), ("mapq", 256), ("pos0", 1 << 31), ("qname", "x" * 255), ("cigar", [{"op": 0, "len": 1 << 28}])):
        kind = batch.schema.field(field).type if field in ("qname", "cigar") else pa.int64()
        with pytest.raises(ValueError):
            bam.records_bytes(pa.RecordBatch.from_arrays([pa.array([value], kind)], [field]))


def test_tags_are_read_by_arrays():
    """All kinds of tags, of records with none, one and several of a name, at a part of the time of one by one."""
    kinds = b"NMC\x05" + b"ASs\xfe\xff" + b"XIi\xff\xff\xff\xff" + b"XFf\x00\x00\x80\x3f" + b"XAAq" + b"XHH0aF\0" + b"XBBs" + struct.pack("<i2h", 2, 1, -1) + b"XEZ\0" + b"XUZ\xe9\0"
    wanted = {"NM": "5", "AS": "-2", "XI": "-1", "XF": "1.0", "XA": "q", "XH": "0aF", "XB": "1,-1", "XE": "", "XU": "é"}
    parts = [kinds, b"", b"BXZone\0RVZyes\0BXZtwo\0", b"RVZno\0\1\2"]
    data = b"head" + b"....".join(parts)
    ends = np.cumsum([len(x) + 4 for x in parts])
    found = bam.tags_at(data, ends - [len(x) for x in parts], ends).to_pylist()
    assert [dict(x) for x in found] == [wanted, {}, {"BX": "two", "RV": "yes"}, {"RV": "no"}] and [k for k, _ in found[2]] == ["BX", "RV"]
    with pytest.raises(ValueError):
        bam.tags_at(b"BXZabc", np.array([0]), np.array([6]))
    many = b"BXZ0000000000000001\0RVZyes\0" * 50_000
    ends = np.arange(27, len(many) + 1, 27)
    began = time.process_time()
    assert len(bam.tags_at(many, ends - 27, ends)) == 50_000
    assert time.process_time() - began < 50_000 * 3.5e-6  # one by one some 5 us each
