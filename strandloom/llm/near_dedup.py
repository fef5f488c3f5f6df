"""Near-duplicate documents by order MinHash and banded alignment.

A document's words (lower case, without punctuation) give shingles of five words, each labelled
with how often it occurred before.  A sketch takes the two labelled shingles of least hash
and keeps them in the order of the text, so it agrees for two documents if these share much of
their text in the same order.  Thirty sketches are taken.

Documents that agree in a sketch meet in a bucket.  A pair is a link if its words align within
a band of a fifth of the longer text, that is, with an edit similarity of 0.8 or more.  Linked
documents form classes.  Every two documents that meet are aligned, or are known to be of one class, or
have lengths or words that rule a link out.  Three rounds see to it: first every document is compared with
the first one of all it meets; then, where a bucket still holds several classes, with the document that is
in most of such buckets; at last all pairs of different classes of a bucket, in blocks.

Of texts that are the same, only one goes through all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, discard, documents, materialize, text_of, text_or_empty
from .components import components
from .language import _bytes_of

SHINGLE = 5
SKETCHES, MINIMA = 30, 2
SIMILARITY = 0.8
SLICE_BYTES = 1 << 20
#: Up to so many documents to align (some 60 bytes each) are broadcast to select their texts, else joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Words of a text are counted by hash in so many bins, of a byte each.
BINS = 1024
#: Documents of a bucket and a size class that are compared with each other at once.
BLOCK = 2048
#: Alignments of more edits than this are done by columns of bits instead of diagonals.
FEW_EDITS = 12
#: The narrowest band tried so; a step's cost hardly depends on it up to there.
FIRST_BAND = 512
#: Up to so many bits in all, the places of each word are kept as a whole number; else they are put together when needed.
MASK_BITS = 1 << 28

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a text in bytes: their hashes and where they start."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = _WORD[data]
    turns = np.diff(mask)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    inside = np.flatnonzero(mask[1:-1])
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(begin, lengths)
    sums = np.add.reduceat((_LOWER[data[inside]] + np.uint64(1)) * _powers(int(lengths.max()))[place], begin)
    return _mixed(sums + lengths.astype(np.uint64)), starts


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key came before."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(keys), np.uint64)
    if len(again):
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys)
        order = at[np.argsort(keys[at], kind="stable")]
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        runs = np.diff(np.append(first, len(order)))
        out[order] = (np.arange(len(order)) - np.repeat(first, runs)).astype(np.uint64)
    return out


def sketches(words: np.ndarray, counts: np.ndarray, number: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """Sketches (texts, number) of texts with counts[i] > 0 words each, one after the other in words."""
    ends = np.cumsum(counts)
    n = np.maximum(counts - SHINGLE + 1, 1)
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) - begin[of] + (ends - counts)[of]
    key = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < ends[of]  # texts of fewer words are one shingle
        key = key * _ODD + np.where(there, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))
    key = _mixed(key)
    key = _mixed(key + _occurrences(key ^ _mixed(of.astype(np.uint64) * _ODD)) * np.uint64(0xD1342543DE82EF95))

    out = np.empty((len(counts), number), np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    seeds = np.random.default_rng(5).integers(1, 1 << 62, (number, 2)).astype(np.uint64)
    for j, (a, b) in enumerate(seeds):
        order = _mixed(key * (a * np.uint64(2) + np.uint64(1)) + b)
        places = np.full((minima, len(counts)), len(key), np.int64)  # len(key): the text has fewer shingles
        for i in range(minima):
            least = np.minimum.reduceat(order, begin)
            hit = np.flatnonzero(order == np.repeat(least, n))
            hit = hit[order[hit] != most]
            texts, first = np.unique(of[hit], return_index=True)
            places[i, texts] = hit[first]
            order[hit[first]] = most
        places.sort(axis=0)
        chosen = np.append(key, np.uint64(j))[places]
        total = np.full(len(counts), np.uint64(j + 1))
        for row in chosen:
            total = _mixed(total * _ODD + row)
        out[:, j] = total.view(np.int64)
    return out


def _sketched(number: int, minima: int):  # noqa: ANN202
    """Rows (row, doc_id, rid, digest, text) with n_words, sketch and bag (words by bin, 255 at most) instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(text_of(batch))
            bags = np.zeros((len(batch), BINS), np.uint8)
            n_words, rows = np.zeros(len(batch), np.int64), np.full((len(batch), number), 0, np.int64)
            start = 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
                lengths = np.diff(offsets[start : end + 1])
                spaced = np.full(int(lengths.sum() + len(lengths)), 32, np.uint8)  # a space after each text
                shift = np.repeat(np.arange(len(lengths)), lengths)
                spaced[np.arange(len(shift)) + shift] = data[offsets[start] : offsets[end]]
                words, places = word_hashes(spaced)
                limits = np.cumsum(lengths + 1)
                of = np.searchsorted(limits, places, "right")
                counts = np.bincount(of, minlength=len(lengths))
                n_words[start:end] = counts
                in_bins = np.bincount(of * BINS + (words % np.uint64(BINS)).astype(np.int64), minlength=len(lengths) * BINS)
                bags[start:end] = np.minimum(in_bins, 255).reshape(-1, BINS)
                full = np.flatnonzero(counts)
                if len(full):
                    rows[start + full] = sketches(words, counts[full], number, minima)
                start = end
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * number), pa.array(rows.reshape(-1)))
            at = pa.py_buffer(np.arange(len(batch) + 1, dtype=np.int32) * np.int32(BINS))
            bag = pa.Array.from_buffers(pa.binary(), len(batch), [None, at, pa.py_buffer(bags)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n_words), sketch, bag], [*batch.schema.names[:4], "n_words", "sketch", "bag"])

    return run


def _by_diagonals(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance up to ``most``: how far each diagonal of the band reaches with so many edits."""
    n, m = len(a), len(b)
    reached, goal = [-(1 << 40)] * (2 * most + 3), m - n  # of diagonal d at d + most + 1
    for e in range(most + 1):
        now = reached.copy()
        for d in range(max(-e, -n, goal - most + e), min(e, m, goal + most - e) + 1):  # others cannot reach the goal any more
            k = d + most + 1
            i = min(max(reached[k] + 1, reached[k - 1], reached[k + 1] + 1), n, m - d) if e else 0
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            now[k] = i
            if d == goal and i >= n:
                return e
        reached = now
    return None


def _places(a: np.ndarray, kinds: int):  # noqa: ANN202
    """A function of a symbol, a row and a width: which of so many rows from there on (the first is 1) hold the symbol, as bits."""
    order = np.argsort(a, kind="stable")
    at = np.split(order, np.cumsum(np.bincount(a, minlength=kinds))[:-1])
    bits = lambda places, width: int.from_bytes(np.packbits(np.bincount(places, minlength=width)[:width].astype(bool), bitorder="little").tobytes(), "little")
    if kinds * len(a) <= MASK_BITS:
        whole = [bits(x, len(a)) for x in at]
        return lambda c, row, width: (whole[c] >> (row - 1) if row > 0 else whole[c] << (1 - row)) & ((1 << width) - 1)

    def window(c: int, row: int, width: int) -> int:
        low, high = np.searchsorted(at[c], (row - 1, row - 1 + width))
        return bits(at[c][low:high] - (row - 1), width)

    return window


def _by_bits(a: np.ndarray, b: np.ndarray, kinds: int, most: int) -> int | None:
    """Edit distance up to ``most``, with a column of the band in a few whole numbers; a is not the shorter one.

    Column j holds the rows from j - most to j + most, a bit for each: where the value goes up or down by one from
    the row before.  Beyond the band's borders values go up, which never makes a path cheaper than it is; rows up
    to 0 go on as if there were symbols that match nothing.  The goal lies on one diagonal, that is, at one and the
    same bit in all columns, and values never fall along a diagonal.
    """
    width, holds = 2 * most + 1, _places(a, kinds)
    every, goal = (1 << width) - 1, 1 << (len(a) - len(b) + most)
    down = (1 << (most + 1)) - 1
    up, value, last = every ^ down, len(a) - len(b), 1 << (width - 1)
    for j, c in enumerate(b.tolist(), 1):
        up, down = up >> 1 | last, down >> 1
        same = holds(c, j - most, width) | down
        level = ((((same & up) + up) ^ up) | same) & every  # the diagonal step costs nothing
        if not level & goal:
            value += 1
            if value > most:
                return None
        right_up, right_down = ((down | (every ^ (level | up))) << 1 | 1) & every, (level & up) << 1 & every
        up, down = right_down | (every ^ (level | right_up)), right_up & level
    return value


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences of words, or None if it is over ``most``.

    Only the diagonals of a band of ``most`` to either side are looked at.
    """
    if abs(len(a) - len(b)) > most:
        return None
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    kinds, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = n[: len(a)], n[len(a) :]
    in_a, in_b = (np.bincount(x, minlength=len(kinds)) for x in (a, b))
    if len(a) - int(np.minimum(in_a, in_b).sum()) > most:  # words without a partner
        return None
    found, band = _by_diagonals(a.tolist(), b.tolist(), min(most, FEW_EDITS)), FEW_EDITS
    while found is None and band < most:  # in long texts of few edits a narrow band is enough
        band = min(most, max(FIRST_BAND, 4 * band))
        found = _by_bits(a, b, len(kinds), band) if len(a) - len(b) <= band else None
    return found


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = lambda text: word_hashes(np.frombuffer(text.encode(), np.uint8))[0]
    for batch in batches:
        found, known = [], {}
        for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"], strict=True):
            if a not in known:
                known = {a: words(left)}
            x, y = known[a], words(right)
            edits = edit_distance(x, y, int((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9))
            if edits is not None:
                found.append((a, b, 1 - edits / max(len(x), len(y), 1)))
        yield pd.DataFrame(found, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})


def size_class() -> Column:
    """Texts of which one has a fifth more words than the other are at most one class apart."""
    return F.floor(F.log(F.col("n_words").cast("double")) / F.lit(float(np.log(1 / SIMILARITY)))).cast("long")


def buckets(firsts: DataFrame, n: int) -> DataFrame:
    """n firsts (rid, doc_id, n_words, sketch) as a row for each bucket of two or more that they are in."""
    j = F.expr("posexplode(sketch) as (j, key)")
    rows = firsts.filter("n_words > 0").select("rid", "doc_id", j, size_class().alias("size_class"), "n_words")
    shared = rows.groupBy("j", "key").agg(F.min(F.struct("doc_id", "rid", "n_words")).alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return materialize(rows.join(shared, ["j", "key"]), "near-buckets", n)


def candidates(met: DataFrame) -> DataFrame:
    """The first round's pairs (a, b), a < b, of what buckets() gives: each document with the first one by doc_id of all it meets.

    Of the buckets' first ones those count whose lengths allow a link.  Copies of one text mostly meet the
    same first document, so this makes them one class at the price of one pair each.
    """
    longer = F.greatest("n_words", "low.n_words")  # each word of difference in length is an edit
    near = longer - F.least("n_words", "low.n_words") <= F.floor(longer * (1 - SIMILARITY) + 1e-9)
    one = met.filter(F.col("rid") != F.col("low.rid")).filter(near).groupBy("rid").agg(F.min(F.struct("low.doc_id", "low.rid")).alias("first"))
    return one.select(F.least("rid", "first.rid").alias("a"), F.greatest("rid", "first.rid").alias("b")).distinct()


def _crossed(hubs: bool):  # noqa: ANN202
    """Groups of rows of remaining(), in their order, as pairs of different classes whose lengths and words allow a link."""
    keys = ["j", "key", "home", "low", "high"]

    def group(x: dict[str, np.ndarray], bags: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n, root, own, part = x["n_words"], x["root"], x["size_class"] == x["home"], x["part"]
        need = n - np.floor(n * (1 - SIMILARITY) + 1e-9).astype(np.int64)  # words in common, if n is the longer one
        ends, whole = np.searchsorted(need, n, "right"), x["low"][0] == x["high"][0]
        lost = n - bags.sum(1, dtype=np.int64)  # beyond 255 in a bin
        hub = int(np.lexsort((x["rid"], x["degree"]))[-1])
        for i in [hub] if hubs else np.flatnonzero(own):
            others = np.arange(0 if hubs else i + 1, ends[i])
            fits = (root[others] != root[i]) & (own[others] | own[i])
            if hubs:
                fits &= need[i] <= n[others]
            elif not whole:
                fits &= part[others] != part[i]
            others = others[fits]
            if len(others) and not hubs:  # a pair that meets in several buckets is compared in the first of them
                others = others[~(marks[others] == marks[i]).any(1)]
            if len(others):
                common = np.minimum(bags[others], bags[i]).sum(1, dtype=np.int64) + np.minimum(lost[others], lost[i])
                others = others[common >= np.maximum(need[others], need[i])]
            if len(others):
                yield i, others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> pa.RecordBatch:
            x = {c: rows[c].to_numpy() for c in rows.column_names if c not in ("bag", "sketch")}
            bags = np.frombuffer(b"".join(rows["bag"].to_pylist()), np.uint8).reshape(-1, BINS)
            marks = np.zeros((len(bags), 0)) if hubs else rows["sketch"].combine_chunks().flatten().to_numpy().reshape(len(bags), -1)
            turns = np.zeros(len(bags), bool)
            for c in keys:
                turns[1:] |= x[c][1:] != x[c][:-1]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            limits = [0, *np.flatnonzero(turns).tolist(), len(bags)]
            for start, end in zip(limits, limits[1:], strict=False):
                rid = x["rid"][start:end]
                if (x["root"][start:end] == x["root"][start]).all():
                    continue
                for i, others in group({c: v[start:end] for c, v in x.items()}, bags[start:end], marks[start:end, : x["j"][start]]):
                    a.append(np.minimum(rid[i], rid[others]))
                    b.append(np.maximum(rid[i], rid[others]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held = None  # the last group, which may go on
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            same = np.ones(len(rows), bool)
            for c in keys:
                values = rows[c].to_numpy()
                same &= values == values[-1:]
            begin = int(same.argmax()) if len(rows) else 0
            if begin:
                yield pairs(rows.slice(0, begin))
            held = rows.slice(begin)
        if held is not None and len(held):
            yield pairs(held)

    return run


def opened(met: DataFrame, label: DataFrame, n: int) -> DataFrame:
    """(j, key, rid, n_words, size_class, root, degree): the rows of buckets whose documents are not all of one class by label (rid, root), and in how many of these a document is."""
    rows = met.select("j", "key", "rid", "n_words", "size_class").join(label, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    mixed = rows.groupBy("j", "key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("j", "key")
    rows = rows.join(mixed, ["j", "key"]).withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("rid")))  # of a row for each sketch at most
    return materialize(rows, "near-open", n)


def few(table: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast where they are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def grouped(rows: DataFrame) -> DataFrame:
    """(j, key, homes): for each bucket of rows the groups that hold pairs of different classes, as (home, hub, top, bulk, rest).

    A group has the documents of a size class, its home, which are paired with each other and with those of the next one.
    hub: the document in most open buckets; top: the class of most of its documents, of which there are bulk; rest: how many others there are.
    """
    both = rows.withColumn("home", F.explode(F.array("size_class", F.col("size_class") - 1)))
    begun, hub = F.max(F.col("size_class") == F.col("home")).alias("begun"), F.max(F.struct("degree", "rid")).alias("hub")
    by_class = both.groupBy("j", "key", "home", "root").agg(F.count(F.lit(1)).alias("n"), begun, hub)
    groups = by_class.groupBy("j", "key", "home").agg(F.sum("n").alias("n"), F.max("begun").alias("begun"), F.max("hub").alias("hub"), F.max(F.struct("n", "root")).alias("top"))
    group = F.struct("home", F.col("hub.rid").alias("hub"), F.col("top.root").alias("top"), F.col("top.n").alias("bulk"), (F.col("n") - F.col("top.n")).alias("rest"))
    return groups.filter("begun and n > top.n").groupBy("j", "key").agg(F.collect_list(group).alias("homes"))  # size classes are few


def dealt(rows: DataFrame, hubs: bool) -> DataFrame:
    """rows with home, hub, top, bulk and rest, as a row for each block (low, high) of its group that a document is in; part: where it is there.

    With ``hubs`` a group's documents are in one block each, and its hub is in all of them.  Else
    documents of a group's top class, which are not paired with each other, meet the parts of the
    rest alone; only the rest meets all parts.  A rest of one block so makes a few rows for each
    document at most, however large the group is.
    """
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    bulk, rest = parts(F.col("bulk")), parts(F.col("rest"))
    whole, small = parts(F.col("bulk") + F.col("rest")), F.col("bulk") + F.col("rest") <= BLOCK
    slot = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    if hubs:
        everywhere = F.when(F.col("rid") == F.col("hub"), F.sequence(F.lit(0), whole - 1))
        rows = rows.withColumn("part", slot(whole)).withColumn("low", F.explode(F.coalesce(everywhere, F.array("part"))))
        return rows.withColumn("high", F.col("low"))
    in_top = F.col("root") == F.col("top")
    part = F.when(small, 0).when(in_top, rest + slot(bulk)).otherwise(slot(rest))
    number = F.when(small, 1).when(in_top, rest).otherwise(rest + bulk)
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), number - 1)))
    return rows.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})


def remaining(rows: DataFrame, carried_on: DataFrame, pairs: DataFrame, hubs: bool, n: int) -> DataFrame:
    """Pairs (a, b), a < b, each once, that meet in a bucket of rows, differ in root, may be links and are not among pairs.

    A link's lengths differ by a fifth at most, and as much of the longer text's words, counted in
    bins, are in both: other pairs are left out.  Of each group only the document that is in
    most open buckets is paired with the others if ``hubs``, else every two are.
    carried_on: (rid, bag, sketch) of the documents in rows, which are joined with a row for each document, not for each of its buckets.
    """
    homes = F.filter("homes", lambda x: (x["home"] == F.col("size_class")) | (x["home"] == F.col("size_class") - 1))
    placed = rows.join(grouped(rows), ["j", "key"]).withColumn("homes", homes).filter(F.size("homes") > 0)
    own = ["rid", "n_words", "size_class", "root", "degree"]
    each = placed.groupBy(*own).agg(F.collect_list(F.struct("j", "key", "homes")).alias("places")).join(carried_on, "rid")
    kept = [*own, "bag", *([] if hubs else ["sketch"])]
    groups = each.select(*kept, F.explode("places").alias("place")).select(*kept, "place.j", "place.key", F.explode("place.homes").alias("group")).select(*kept, "j", "key", "group.*")
    columns = ["j", "key", "home", "low", "high", "n_words", "rid", "root", "size_class", "part", "degree", *kept[len(own) :]]
    blocks = dealt(groups, hubs).select(*columns).repartition(*columns[:5]).sortWithinPartitions(*columns[:7])
    found = blocks.mapInArrow(_crossed(hubs), "a long, b long").distinct()
    return materialize(found.join(pairs, ["a", "b"], "left_anti"), "near-pairs", n)


def identifier() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")


def aligned(docs: DataFrame, digest: Column, firsts: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The links (a, b) among pairs (a, b) of firsts, whose texts are those of docs; n: of the order of the pairs."""
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    needed = materialize(firsts.join(ends, "rid", "left_semi").select(F.col("digest").alias("of"), F.col("doc_id").alias("of_id"), "rid"), "near-needed", n)
    texts = docs.select("doc_id", text_or_empty().alias("text"), digest.alias("digest"))
    texts = texts.join(few(needed), (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("rid", "text").dropDuplicates(["rid"])
    texts = materialize(texts, "near-texts", n)
    sided = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("rid").alias("a"), F.col("text").alias("left")), "a")
    links = sided.select("a", "b", "left", "right").mapInPandas(_aligned, "a long, b long, similarity double")
    links = materialize(links, "near-links", n)
    discard(texts, needed)
    return links.select("a", "b")


def classes(docs: DataFrame, keep: list[str] | None = None, number: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """docs (doc_id, text, ...) as (row, class_id, class_size, kept).

    class_id is the smallest doc_id of the class (null if none has one), whose row stays; of
    repeated rows exactly one does.  Equal texts are one class; null counts as empty.  A text
    without any word is near to nothing but its equals; one of fewer than five words is a
    shingle as a whole.  Texts of any length are sketched and aligned whole; columns of docs may
    have any names; an empty table gives an empty one.  number, minima: how many sketches there
    are, and of how many shingles each; more of the former find more of the pairs that are just
    links, more of the latter make buckets smaller and stricter about order.
    """
    columns = docs.columns if keep is None else keep
    digest = F.unhex(F.sha2(text_or_empty().cast("binary"), 256))
    rows = carried(docs, columns, F.col("doc_id"), F.monotonically_increasing_id().alias("rid"), digest.alias("digest"))
    schema = rows.drop("text").schema.add("n_words", "long").add("sketch", T.ArrayType(T.LongType())).add("bag", "binary")
    sketched = materialize(rows.mapInArrow(_sketched(number, minima), schema), "near-sketches")
    first = F.min_by(F.struct("doc_id", "rid", "n_words", "sketch", "bag"), identifier())
    n = sketched.count()  # of a written table: footers only
    firsts = materialize(sketched.groupBy("digest").agg(first.alias("first")).select("digest", "first.*"), "near-firsts", n)

    met = buckets(firsts, n)
    pairs = materialize(candidates(met), "near-pairs", n)
    links = aligned(docs, digest, firsts, pairs, n)
    edges, carried_on, written = components(links, n), None, [pairs, met, links]
    for hubs in (True, False):
        rows = opened(met, edges.select(F.col("a").alias("rid"), F.col("b").alias("root")), n)
        written.append(rows)
        if not rows.limit(1).count():
            break
        if carried_on is None:  # later on, no others are open
            open_ids = materialize(rows.select("rid").distinct(), "near-open-ids", n)
            carried_on = materialize(firsts.join(few(open_ids), "rid").select("rid", "bag", "sketch"), "near-bags", n)
            written += [open_ids, carried_on]
        more = remaining(rows, carried_on, pairs, hubs, n)
        written.append(more)
        if not more.limit(1).count():
            continue
        links = aligned(docs, digest, firsts, more, n)
        written.append(links)
        if links.limit(1).count():
            before, edges = edges, components(edges.union(links), n)
            discard(before)
        pairs = pairs.union(more)
    discard(*written)

    label = edges.select(F.col("a").alias("rid"), F.col("b").alias("root"))
    member = firsts.select("digest", "rid").join(label, "rid", "left").select("digest", F.coalesce("root", "rid").alias("root"))
    slim = sketched.select("doc_id", "rid", "digest").join(member, "digest")
    best = slim.groupBy("root").agg(F.min(identifier()).alias("best"), F.count(F.lit(1)).alias("class_size"))
    found = slim.join(best, "root").select("rid", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("best.rid")).alias("kept"))
    return sketched.select("row", "rid").join(found, "rid").drop("rid")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every document."""
    return classes(documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", "class_id", "class_size", "kept")
