"""Packing documents into sequences of tokens along a space-filling curve.

Each document is tokenised whole and ended by a separator.  Its vector is the mean of hashed
directions of its tokens in a few dimensions; the vector's cell gives its place on a Hilbert
curve.  The documents are sorted by that place, their tokens form one stream, and the stream
is cut every 2048 tokens: neighbours on the curve share sequences, every token lies in exactly
one piece and only the last sequence is padded.

The tokens are written once and not sorted.  What is range-sorted is a slim table of places
and counts; a document's start in the stream is the sum over the partitions before its own
plus a running sum inside it, and that start alone tells where its tokens are cut.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from sys import byteorder
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, documents, materialize, text_of

SEQUENCE = 2048
#: Ends every document.
SEPARATOR = 1
TOKENIZER = "word_bpe_49k.json"
DIMENSIONS, BITS = 3, 10
#: Documents sorted by one task, about.
SORT_ROWS = 200_000
#: Words remembered by a task with their ids, and texts tokenised at once in bytes.
MEMO_WORDS = 200_000
BATCH_BYTES = 4 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Ids of the parts of texts that were met lately, as little-endian unsigned 16-bit numbers.

    A part is what stands between spaces and line feeds, in bytes, with A-Z in lower case.
    Most parts are a word of Latin letters, maybe with a mark behind it; such a word is one
    unit for the tokenizer's model, which is then asked directly.  All others are encoded in
    the usual way.
    """

    #: Bytes as the characters by which byte-level vocabularies write them.
    PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
    #: Marks that never join with letters before them.
    MARKS = frozenset(b".,;:!?")

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}
        rest = iter(range(256, 512))
        self.written = {b: chr(b) if b in self.PRINTED else chr(next(rest)) for b in range(256)}

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if len(part) > 1 and part[-1] in self.MARKS and self.is_word(part[:-1]):
                ids = self[part[:-1]] + self[part[-1:]]
            elif self.is_word(part):
                ids = array("H", [t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.written))]).tobytes()
            else:
                ids = array("H", self.tokenizer.encode(part.decode(), add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids

    @staticmethod
    def is_word(part: bytes) -> bool:
        """Only letters below U+0250 that lower case and NFC leave as they are."""
        if part.isalpha():
            return True
        text = part.decode()
        return text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text)

    def trim(self) -> None:
        """What was not met since the last time goes, once there is too much."""
        if len(self) > MEMO_WORDS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Token ids of whole texts.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its parts, one after the other.  It has lower case only: A-Z may be lowered first.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16 or byteorder != "little":
            raise ValueError("ids must fit into 16 bits, on a little-endian machine")
        if self.tokenizer.encode("A", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids:
            raise ValueError("the tokenizer must be one of lower case")
        self.memo = Memo(self.tokenizer)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = array("H", [SEPARATOR]).tobytes()

    @classmethod
    @cache
    def of(cls, path: str) -> Encoder:
        """One for each process."""
        return cls(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Texts in UTF-8 as ids in 16-bit numbers, the separator behind each."""
        self.memo.trim()
        get, out = self.memo.__getitem__, []
        for text in texts:
            low = text.lower()
            if any(x in low for x in self.special):
                ids = array("H", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
            else:
                ids = b"".join(map(get, low.replace(b"\n", b" ").split(b" ")))
            out.append(ids + self.end)
        return out


def directions(vocabulary: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A hashed direction for each token id: Gaussian numbers from a fixed seed."""
    return np.random.default_rng(20_48).standard_normal((vocabulary, dimensions)).astype(np.float32)


def cells(means: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates from 0 to 2 ** bits - 1 of mean directions; the scale widens with the spread a mean of so many has."""
    scaled = means * np.sqrt(np.minimum(counts, 256))[:, None] / 4
    return np.clip((np.tanh(scaled) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dimensions), by turning axes bit by bit."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, 0)  # invert the low bits of the first axis, or exchange them with this axis
            x[0] ^= swap
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def tokenised(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """(row, doc_id, rid, ids, doc_tokens, place) of docs, written to the shared folder; ids are 16-bit numbers."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        toward = directions(1 << 16)
        for whole in batches:
            size, start = 0, 0
            text = text_of(whole)
            kept = [whole.schema.names.index(c) for c in ("row", "doc_id", "rid")]
            lengths = pa.compute.binary_length(text).to_pylist()
            ends = []
            for i, n in enumerate(lengths):
                if size and size + n > BATCH_BYTES:
                    ends.append(i)
                    size = 0
                size += n
            for end in [*ends, len(whole)]:
                batch = whole.slice(start, end - start)
                start = end
                if not len(batch):
                    continue
                ids = encoder.encode(text_of(batch).cast(pa.binary()).to_pylist())
                counts = np.array([len(x) // 2 for x in ids])
                flat = np.frombuffer(b"".join(ids), "<u2")
                starts = np.cumsum(counts) - counts
                means = np.add.reduceat(toward[flat], starts, axis=0, dtype=np.float64) / counts[:, None]
                place = hilbert(cells(means, counts))
                columns = [*[batch.column(i) for i in kept], pa.array(ids, pa.binary()), pa.array(counts.astype(np.int64)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "rid", "ids", "doc_tokens", "place"])

    rows = carried(docs, keep, F.col("doc_id"), F.monotonically_increasing_id().alias("rid"))
    schema = rows.drop("text").schema.add("ids", "binary").add("doc_tokens", "long").add("place", "long")
    return materialize(rows.mapInArrow(encoded, schema), "packing-tokens")


def starts(tokens: DataFrame) -> DataFrame:
    """(rid, first): where each document's tokens begin in the stream sorted by (place, doc_id, rid)."""
    slim = tokens.select("place", "doc_id", "rid", "doc_tokens")
    parts = max(1, -(-tokens.count() // SORT_ROWS))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(n) else total
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column("doc_tokens")], ["rid", "part", "inside", "doc_tokens"])

    sorted_rows = slim.repartitionByRange(parts, "place", "doc_id", "rid").sortWithinPartitions("place", "doc_id", "rid")
    placed = materialize(sorted_rows.mapInArrow(running, "rid long, part int, inside long, doc_tokens long"), "packing-places")
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())  # a row for each task
    before, bases = 0, []
    for part, n in sums:
        bases.append((part, before))
        before += n
    base = tokens.sparkSession.createDataFrame(bases, "of int, base long")
    return placed.join(F.broadcast(base), F.col("part") == F.col("of")).select("rid", (F.col("base") + F.col("inside")).alias("first"))


def pack(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, sequence: int = SEQUENCE, crc: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) as pieces (row, doc_tokens, start, length, sequence_id, offset, ids).

    ids: the piece's token ids as little-endian unsigned 16-bit numbers; with ``crc`` they are
    replaced by ids_crc32, the CRC of the ids as little-endian unsigned 32-bit numbers.  Null
    and empty texts are the separator alone.  Very long texts are tokenised whole and cut into as
    many pieces as they need.  Rows at one place of the curve go by doc_id, then as they were
    read; rows that repeat, or have no doc_id, are packed one by one.  Columns of docs may have
    any names; of an empty table there are no pieces.
    """
    columns = docs.columns if keep is None else keep
    tokens = tokenised(docs, columns, path or tokenizer_path())
    placed = tokens.select("rid", "row", "doc_tokens", "ids").join(starts(tokens).hint("shuffle_hash"), "rid").select("row", "doc_tokens", "first", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                first, count = some.column("first").to_numpy(), some.column("doc_tokens").to_numpy()
                pieces = (first + count - 1) // sequence - first // sequence + 1
                of = np.repeat(np.arange(len(some)), pieces)
                number = first[of] // sequence + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.maximum(number * sequence - first[of], 0)
                length = np.minimum((number + 1) * sequence - first[of], count[of]) - start
                ids = [memoryview(x.as_buffer()) for x in some.column("ids")]
                parts = [ids[i][2 * a : 2 * (a + n)] for i, a, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
                if crc:
                    last = pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in parts], pa.int64())
                else:
                    last = pa.array([bytes(x) for x in parts], pa.binary())
                columns = [some.column(c).take(pa.array(of)) for c in ("row", "doc_tokens")]
                columns += [pa.array(x) for x in (start, length, number, first[of] + start - number * sequence)] + [last]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "doc_tokens", "start", "length", "sequence_id", "offset", "ids_crc32" if crc else "ids"]
    schema = placed.select("row", "doc_tokens").schema
    for name in names[2:6]:
        schema = schema.add(name, "long")
    return placed.mapInArrow(cut, schema.add(names[6], "long" if crc else "binary"))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, length, ids) with the pieces' ids joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds SEQUENCE tokens at most
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return joined.select("sequence_id", "length", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    pieces = pack(documents(spark, sf_dir), keep=["doc_id"], crc=True)
    return pieces.select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
