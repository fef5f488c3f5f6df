"""Language identification by prediction by partial matching.

For every language a tree of byte contexts of order 0 to 3 is counted and frozen.  A text
costs, in each language, the exact number of bits that an arithmetic coder with these
statistics would need: a symbol seen in the longest context is coded there, else an escape is
coded and the next shorter context decides, without the symbols that the longer one has ruled
out.  The language with the shortest code wins; the score is its share of 2 ** -bits.

The frozen statistics make the cost of a byte a function of the byte and the three before it,
so the trees of all languages are merged into one table of nodes with a row of costs each and
texts are scored by table look-ups, in slices of bounded size, straight from Arrow's buffers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, documents, materialize, text_of

#: The longest context, in bytes; every text begins after so many line feeds.
ORDER = 3
PAD = np.full(ORDER, 10, np.uint8)
#: About so many labelled documents of a language are counted; whole texts, chosen by a hash of doc_id.
TRAIN_DOCS = 1500
#: The trees' costs, nodes times languages, number about so many at most, whatever is counted: of each
#: language the most frequent grams are kept.  They are broadcast: some 4 bytes each, and as much again for the steps.
TREE_CELLS = 1 << 23
#: Steps of up to so many entries are a plain table, of more a table of hashes, with equal results.
PLAIN_STEPS = 1 << 22
#: A byte that the best language codes in more bits than it has counts as sent as it is.  A text whose bytes then
#: still take so many bits on average is like none of the languages.
RAW_BITS, MOST_BITS = 8, 6.75
#: Texts are scored in slices of so many bytes.
SLICE_BYTES = 1 << 19
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id as text, modulo 4, is 2.  A null id reads as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings (null: empty) and the len + 1 offsets into them."""
    column = column.fill_null("").cast(pa.large_string())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _padded(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of at most SLICE_BYTES: bytes led by ORDER bytes of context, and the number of the text."""
    for i in range(len(offsets) - 1):
        for at in range(offsets[i], offsets[i + 1], SLICE_BYTES):
            end = min(at + SLICE_BYTES, offsets[i + 1])
            lead = PAD if at == offsets[i] else data[at - ORDER : at]
            yield np.concatenate([lead, data[at:end]]), i


def _sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Several texts at once: (bytes, starts of their parts, numbers of the texts), each part led by ORDER bytes of context."""
    parts: list[np.ndarray] = []
    numbers: list[int] = []
    held = 0
    for part, i in _padded(data, offsets):
        if held and held + len(part) > SLICE_BYTES:
            yield np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]]), numbers
            parts, numbers, held = [], [], 0
        parts.append(part)
        numbers.append(i)
        held += len(part)
    if parts:
        yield np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]]), numbers


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of ORDER + 1 bytes in each language of (text, lang)."""
    for batch in batches:
        data, offsets = _bytes_of(batch.column(0))
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        index = np.array([names.index(x) for x in langs], np.uint64)
        for part, starts, numbers in _sliced(data, offsets):
            code = part.astype(np.uint64)
            gram = code.copy()
            for k in range(1, ORDER + 1):
                gram[k:] |= code[:-k] << np.uint64(8 * k)
            lengths = np.diff(np.append(starts, len(part)))
            gram |= np.repeat(index[numbers], lengths) << np.uint64(32)
            real = np.ones(len(part), bool)
            for k in range(ORDER):
                real[starts + k] = False
            keys, n = np.unique(gram[real], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([names[int(k)] for k in keys >> np.uint64(32)], pa.string()), "gram": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(n.astype(np.int64))})


class Steps:
    """From a node and a symbol to the node that follows, 0 if there is none."""

    def __init__(self, nodes: int, width: int, at: np.ndarray, symbol: np.ndarray, to: np.ndarray) -> None:
        self.width, self.plain = width, nodes * width <= PLAIN_STEPS
        keys = at.astype(np.int64) * width + symbol
        if self.plain:
            self.to = np.zeros(nodes * width, np.int32)
            self.to[keys] = to
            return
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.to, left = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.arange(len(keys))
        place = self._place(keys)
        while len(left):  # all that find a free place take it, one each; the others go on
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]
            won = free[self.keys[place[free]] == keys[free]]
            self.to[place[won]] = to[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - len(self.keys).bit_length() + 1)).astype(np.int64)

    def __call__(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        keys = node.astype(np.int64) * self.width + symbol
        if self.plain:
            return self.to[keys]
        out, place, left = np.zeros(len(keys), np.int32), self._place(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.to[place[left[hit]]]
            left = left[~hit & (held >= 0)]
            place[left] = (place[left] + 1) & (len(self.keys) - 1)
        return out


class ContextTrees:
    """Frozen statistics of all languages: nodes for the grams seen anywhere, with a cost in bits for each language."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = langs
        every = np.unique(np.concatenate([grams[x][0] for x in langs])).astype(np.int64)
        seen = np.unique(np.concatenate([(every >> (8 * k)) & 255 for k in range(ORDER + 1)]))
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that training never met
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        width = self.width = len(seen) + 1

        # the grams of each length as numbers to base 256: ends of longer ones, and the contexts of these
        lengths = [every]
        for k in range(ORDER, 0, -1):
            lengths.insert(0, np.unique(np.concatenate([lengths[0] & ((1 << 8 * k) - 1), lengths[0] >> 8])))
        lower = np.full((256, len(langs)), 1 / 256)  # probability of each gram of the length before, in each language
        lower_keys = np.arange(256)
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        self.step: list[Steps] = []
        nodes_before, keys_before = np.zeros(1, np.int64), np.zeros(1, np.int64)  # the empty context
        for k, keys in enumerate(lengths, 1):
            context, contexts = keys >> 8, np.unique(keys >> 8) if k > 1 else np.zeros(1, np.int64)
            at = np.searchsorted(contexts, context) if k > 1 else np.zeros(len(keys), np.int64)
            suffix = np.searchsorted(lower_keys, keys & ((1 << 8 * (k - 1)) - 1 if k > 1 else 255))
            p_lower = lower[suffix]
            p = np.empty((len(keys), len(langs)))
            escape = np.zeros((len(contexts), len(langs)))
            for j, lang in enumerate(langs):
                codes, n = grams[lang]
                count = np.zeros(len(keys))
                np.add.at(count, np.searchsorted(keys, codes & ((1 << 8 * k) - 1)), n)
                total = np.bincount(at, count, len(contexts))
                kinds = np.bincount(at, count > 0, len(contexts))
                ruled_out = np.bincount(at, np.where(count > 0, p_lower[:, j], 0), len(contexts))
                known = total > 0
                leave = np.where(known, kinds / np.maximum(total + kinds, 1) / np.maximum(1 - ruled_out, 1e-6), 1.0)
                p[:, j] = np.where(count > 0, count / np.maximum(total + kinds, 1)[at], leave[at] * p_lower[:, j])
                escape[:, j] = -np.log2(leave)
            # node 0: the gram is not in the trees
            self.cost.append(np.vstack([np.zeros(len(langs)), -np.log2(p)]).astype(np.float32))
            by_node = np.zeros((len(nodes_before) + (k > 1), len(langs)))
            by_node[(np.searchsorted(keys_before, contexts) + 1) if k > 1 else np.zeros(1, np.int64)] = escape
            self.escape.append(by_node.astype(np.float32))
            where = np.searchsorted(keys_before, context) + 1 if k > 1 else np.zeros(len(keys), np.int64)
            self.step.append(Steps(len(by_node), width, where, self.symbol[keys & 255], np.arange(1, len(keys) + 1, dtype=np.int32)))
            keys_before, nodes_before = keys, np.arange(len(keys))
            lower, lower_keys = p, keys

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        return self.lengths(data, offsets)[0]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language; and the same if no byte takes more than RAW_BITS."""
        out, bounded = (np.zeros((len(offsets) - 1, len(self.langs))) for _ in range(2))
        for part, starts, numbers in _sliced(data, offsets):
            symbol = self.symbol[part]
            nodes = [self.step[0](np.zeros(len(part), np.int32), symbol)]
            for k in range(1, ORDER + 1):
                node = np.zeros(len(part), np.int32)
                node[1:] = self.step[k](nodes[-1][:-1], symbol[1:])
                nodes.append(node)
            cost = self.cost[ORDER][nodes[ORDER]]
            rest = np.flatnonzero(nodes[ORDER] == 0)
            for k in range(ORDER, 0, -1):  # escape from the context of k bytes to that of k - 1
                rest = rest[rest >= k]
                cost[rest] += self.escape[k][nodes[k - 1][rest - 1]]
                there = nodes[k - 1][rest] > 0
                cost[rest[there]] += self.cost[k - 1][nodes[k - 1][rest[there]]]
                rest = rest[~there]
            cost[rest] += self.escape[0][0] + np.float32(8)  # a byte that no language has met
            for k in range(ORDER):
                cost[starts + k] = 0
            for sums, each in ((out, cost), (bounded, np.minimum(cost, RAW_BITS))):
                np.add.at(sums, numbers, np.add.reduceat(each, starts, axis=0, dtype=np.float64))
        return out, bounded

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language of each text (ties: the first by name), its share, and its bounded bits for each byte."""
        bits, bounded = self.lengths(data, offsets)
        best = bits.argmin(1)
        return best, 1 / np.exp2(-(bits - bits.min(1, keepdims=True))).sum(1), bounded[np.arange(len(best)), best] / np.maximum(np.diff(offsets), 1)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Of counts (lang, gram, n) the ``most`` rows of each language with the largest n, the smaller gram first of equals.

    A histogram of the counts tells the n of the last rows taken; only of the grams that have
    just this n some may go, and these are picked by a sort that keeps so many of each task.
    """
    histogram: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams")).collect():  # the different counts in a bounded number of texts
        histogram.setdefault(r["lang"], {})[r["n"]] = r["grams"]
    cuts, ties = [], []
    for lang, grams in histogram.items():
        room, last = most, 0
        for n in sorted(grams, reverse=True):
            if grams[n] > room:
                last = n
                break
            room -= grams[n]
        cuts.append((lang, last))
        if last and room:
            ties.append(counts.filter((F.col("lang") == lang) & (F.col("n") == last)).orderBy("gram").limit(room))
    cut = F.broadcast(counts.sparkSession.createDataFrame(cuts, "lang string, last long"))
    return reduce(DataFrame.unionByName, ties, counts.join(cut, "lang").filter("n > last").select("lang", "gram", "n"))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> ContextTrees | None:
    """Fits the trees to about train_docs documents of each language, never to held-out ones.

    Only text and lang are learned from, and whole texts.  Of a language with more documents those
    are taken whose hash of doc_id and text is small enough for a share of train_docs; rows that are the same
    in both are taken together or not at all, and if that leaves no document, all of the language
    are.  None if there is no labelled document.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, train_docs / n))])
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")]
    most = max(1, TREE_CELLS // len(sizes) ** 2)

    def grams(rows: DataFrame) -> pd.DataFrame:
        counts = rows.select("text", "lang").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        return most_frequent(materialize(counts, "language-grams"), most).toPandas()  # TREE_CELLS rows at most

    table = grams(labelled.filter(drawn | (F.lit(train_docs) >= F.create_map(*[F.lit(x) for kv in sorted(sizes.items()) for x in kv])[F.col("lang")])))
    if none := sorted(set(sizes) - set(table["lang"])):
        table = pd.concat([table, grams(labelled.filter(F.col("lang").isin(none)))])
    langs = sorted(table["lang"].unique())
    if not langs:
        return None
    table = table.sort_values(["lang", "n", "gram"], ascending=[True, False, True])
    return ContextTrees(langs, {x: (t["gram"].to_numpy(np.int64), t["n"].to_numpy(np.float64)) for x in langs for t in [table[table["lang"] == x]]})


def identify(docs: DataFrame, keep: list[str] | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """scored() by the languages learned from docs (doc_id, text, lang, ...) themselves."""
    return scored(docs, train(docs, train_docs), keep)


def scored(docs: DataFrame, model: ContextTrees | None, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) as (row, held_out, lang_pred, score, bits).

    ``row`` has the columns ``keep`` of the input (all if None).  bits: the code length in the
    predicted language, in bits for each byte of the text, of which none takes more than RAW_BITS;
    MOST_BITS or more say that the text is like none of the languages.  A text that is null or has no letter gets the language "und",
    score 0 and no bits; so does every text without a model.  Repeated rows are scored
    one by one, very long texts whole, in slices with their full context.  Columns of docs may
    have any names; an empty table gives an empty one.
    """
    columns = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            row, letters, held = batch.columns[:3]
            known = letters.to_numpy(zero_copy_only=False).astype(bool) & (trees is not None)
            lang, score, bits = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch)), np.zeros(len(batch))
            if known.any():
                best, share, each = trees.best(*_bytes_of(text_of(batch)))
                lang[known], score[known], bits[known] = np.array(trees.langs, object)[best[known]], share[known], each[known]
            yield pa.RecordBatch.from_arrays([row, held, pa.array(lang, pa.string()), pa.array(score), pa.array(bits, mask=~known)], ["row", "held_out", "lang_pred", "score", "bits"])

    rows = carried(docs, columns, has_letter().alias("letters"), held_out(F.col("doc_id")).alias("held_out"))
    schema = rows.select("row", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema.add("bits", "double")
    return rows.mapInArrow(judged, schema)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def in_a_language() -> Column:
    """Whether identify() has found a language that the text is like."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("bits") < MOST_BITS)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every document."""
    found = identify(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("row.doc_id", "held_out", "lang_pred", "score", "bits")
