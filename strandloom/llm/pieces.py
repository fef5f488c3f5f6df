"""SentencePiece's byte-pair ids of whole texts, and the texts of ids.

Encoding merges the neighbours that make the best piece, again and again, until none make one.
It is found here without merging.  Of every prefix of a text only the last token of its
encoding is kept in a table.  An automaton gives the pieces that end at a place; exactly one of
them is the last token there, the one that is compatible with the last token before it: when
the two are merged side by side, no merge ever crosses the border between them.  Then the ids
are read off from the end, each token telling where the one before it ends.  The work grows
with the length of the text, whatever the text is.

Compatible pairs suffice, as the first merge that crosses a border in a text would cross it in
the pair alone too.  What a piece looks like at its two edges, merge by merge, is noted once;
a pair is tested by running the two notes against each other.

No piece goes over the start of a run of spaces, or joins characters of different families, as
letters and marks, so texts are cut there, and what was encoded lately is looked up.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import bound_batches, carried, documents, text_of

MODEL = "piece_bpe_32k.model"
#: Fixed values of the file format: types of pieces, the mark of a space, what an unknown id is shown as.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
SPACE, UNKNOWN_SHOWN = "▁", " ⁇ "
#: Cuts of at most so many characters are remembered, so many at once, and so many pairs' tests.
MEMO_LENGTH, MEMO_CUTS, MEMO_PAIRS = 64, 200_000, 400_000
#: Texts of more characters are cut one by one instead of into a list.
LONG_TEXT = 1 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces of a model file: (piece, score, type) by id, and whether texts get a space in front."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer, normalizer = (dict(x for number, value in parts if number == n for x in fields(value)) for n in (2, 3))
        self.pieces = []
        for number, value in parts:
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        self.prefix = bool(normalizer.get(3, 1))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("the model must be one of byte pairs that falls back to bytes and marks the starts of words")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model must leave characters and spaces as they are")
        if any(kind in (USER_DEFINED, UNUSED) for *_, kind in self.pieces):
            raise ValueError("the model must not have pieces of the user's own or unused ones")

    @classmethod
    @cache
    def of(cls, path: str) -> Vocabulary:
        """One for each process."""
        return cls(path)


class Edges:
    """How a piece looks at its edges while its characters are merged: the merges' scores, and the symbols at either edge before each and after the last."""

    __slots__ = ("scores", "lefts", "rights", "sound")

    def __init__(self, piece: str, score: dict[str, float]) -> None:
        symbols = list(piece)
        self.scores, self.lefts, self.rights = [], symbols[:1], symbols[-1:]
        while True:
            best = max(((score[x + y], -i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in score), default=None)
            if best is None:
                break
            i = -best[1]  # the leftmost of the best
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
            self.scores.append(best[0])
            self.lefts.append(symbols[0])
            self.rights.append(symbols[-1])
        #: Whether the piece's characters come to be the piece.
        self.sound = len(symbols) == 1


def families(pieces: Iterator[str]) -> list[str]:
    """The characters that stand beside others in pieces, together with all they are so connected to; spaces in front apart."""
    family: dict[str, set[str]] = {}
    for piece in pieces:
        chars = piece.lstrip(SPACE)
        joined = set(chars).union(*(family.get(x, ()) for x in chars)) if len(chars) > 1 else ()
        family.update(dict.fromkeys(joined, joined))
    return sorted({"".join(sorted(x)) for x in family.values()}, key=lambda x: (-len(x), x))


class Suffixes(dict):
    """An automaton's state, the longest end of what was read that begins a piece: the states that follow it, by character.

    States are made when they are first come to.  ``ends``: the pieces that end here, the longest first, as (id, length, what is known of the
    tokens that they are compatible with).
    """

    __slots__ = ("read", "ends", "pieces", "begun", "states")

    def __init__(self, read: str, pieces: dict[str, tuple[int, int, dict[int, bool]]], begun: set[str], states: dict[str, Suffixes]) -> None:
        super().__init__()
        self.read, self.pieces, self.begun, self.states = read, pieces, begun, states
        self.ends = [pieces[x] for x in (read[i:] for i in range(len(read))) if x in pieces]
        states[read] = self

    def __missing__(self, char: str) -> Suffixes:
        read = self.read + char
        while read not in self.begun:
            read = read[1:]
        self[char] = found = self.states.get(read) or Suffixes(read, self.pieces, self.begun, self.states)
        return found


class Memo(dict):
    """What was encoded lately: ids of cuts, as 32-bit numbers."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, cut: str) -> bytes:
        found = self.old.get(cut) or self.encoder.tokens(cut.replace(" ", SPACE))
        if len(cut) <= MEMO_LENGTH:
            self[cut] = found
        return found

    def trim(self) -> None:
        """What was not met since the last time goes, once there is too much."""
        if len(self) > MEMO_CUTS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts, without those of begin and end."""

    #: Stands before the first token.
    START = 1 << 30

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary.of(path)
        self.score = {piece: score for piece, score, kind in self.vocabulary.pieces if kind == NORMAL}
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(self.vocabulary.pieces) if kind == NORMAL}
        self.bytes = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(self.vocabulary.pieces) if kind == BYTE}
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.ids):
            raise ValueError("the model must not have pieces that go over the start of a run of spaces")
        self.chars = {y for x in self.ids for y in x}
        if self.chars - self.ids.keys():
            raise ValueError("every character of a piece must be a piece")
        runs = [f"[{re.escape(x)}]+" for x in families(self.ids)]
        self.cuts = re.compile(" *(?:" + "|".join([*runs, "[^ ]"]) + ")| +")
        self.pieces = {piece: (i, len(piece), {}) for piece, i in self.ids.items()}
        self.automaton = Suffixes("", self.pieces, {x[:i] for x in self.ids for i in range(len(x) + 1)}, {})
        self.lengths = [len(piece) for piece, *_ in self.vocabulary.pieces]
        self.edges: dict[int, Edges] = {}
        self.tested = 0
        self.memo = Memo(self)

    @classmethod
    @cache
    def of(cls, path: str) -> Encoder:
        """One for each process."""
        return cls(path)

    def edges_of(self, token: int) -> Edges:
        """token: an id, or a character that is no piece, as the complement of its code point."""
        if token not in self.edges:
            self.edges[token] = Edges(self.vocabulary.pieces[token][0] if token >= 0 else chr(~token), self.score)
        return self.edges[token]

    def compatible(self, first: int, second: int) -> bool:
        """Whether two tokens stay as they are side by side; at the start of a text, whether the second does alone."""
        self.tested += 1
        if first == self.START:
            return self.edges_of(second).sound
        return self.edges_of(second).sound and self._stay_apart(self.edges_of(first), self.edges_of(second))

    def _stay_apart(self, a: Edges, b: Edges) -> bool:
        """Whether no merge crosses the border of two tokens.

        Either token's merges come in the order it has alone; of the two next ones the better
        comes first, the left one if they are alike.  A merge over the border comes before that
        if it is better than the left one's and no worse than the right one's, which lies behind it.
        """
        i = j = 0
        while True:
            left = a.scores[i] if i < len(a.scores) else None
            right = b.scores[j] if j < len(b.scores) else None
            across = self.score.get(a.rights[i] + b.lefts[j])
            if across is not None and (left is None or across > left) and (right is None or across >= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left >= right):
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[int]:
        """For the end of each prefix of text, in characters, the last token of its encoding."""
        last: list[int] = [self.START]
        root = state = self.automaton
        for end, char in enumerate(text, 1):
            state = state[char] if char in self.chars else root
            token = ~ord(char)
            for token, length, known in state.ends:
                first = last[end - length]
                fits = known.get(first)
                if fits is None:
                    fits = known[first] = self.compatible(first, token)
                if fits:
                    break
            last.append(token)
        return last

    def tokens(self, text: str) -> bytes:
        """Ids, as 32-bit numbers, of a text whose spaces are marked."""
        if self.tested > MEMO_PAIRS:
            self.tested = 0
            for *_, known in self.pieces.values():
                known.clear()
        last, out, end = self.last_tokens(text), array("i"), len(text)
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= self.lengths[token]
            else:
                out.extend(self.bytes[b] for b in reversed(chr(~token).encode()))
                end -= 1
        out.reverse()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        self.memo.trim()
        if not text:
            return b""
        spaced = (" " if self.vocabulary.prefix else "") + text.replace(SPACE, " ")
        cuts = self.cuts.findall(spaced) if len(spaced) < LONG_TEXT else (x.group() for x in self.cuts.finditer(spaced))
        return b"".join(map(self.memo.__getitem__, cuts))


class Decoder:
    """Texts of ids."""

    def __init__(self, path: str) -> None:
        vocabulary = Vocabulary.of(path)
        shown = {NORMAL: lambda x: x.replace(SPACE, " ").encode(), BYTE: lambda x: bytes([int(x[3:5], 16)]), CONTROL: lambda _: b"", UNKNOWN: lambda _: UNKNOWN_SHOWN.encode()}
        self.shown = [shown[kind](piece) for piece, _, kind in vocabulary.pieces]
        self.control = {i for i, (*_, kind) in enumerate(vocabulary.pieces) if kind == CONTROL}
        self.spaced = [vocabulary.prefix and kind == NORMAL and piece.startswith(SPACE) for piece, _, kind in vocabulary.pieces]

    @classmethod
    @cache
    def of(cls, path: str) -> Decoder:
        """One for each process."""
        return cls(path)

    def decode(self, ids: list[int]) -> str:
        """The space in front goes; bytes that are no character become one U+FFFD each."""
        first = next((i for i in ids if self.shown[i]), None)
        skip = int(first is not None and self.spaced[first])
        if self.control.isdisjoint(ids):
            return self._text(b"".join(map(self.shown.__getitem__, ids)))[skip:]
        runs = (run for control, run in groupby(ids, self.control.__contains__) if not control)  # no character goes over those
        return "".join(self._text(b"".join(map(self.shown.__getitem__, run))) for run in runs)[skip:]

    @staticmethod
    def _text(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as wrong:
                out += [data[at : at + wrong.start].decode(), "�" * (wrong.end - wrong.start)]
                at += wrong.end
        return "".join(out)


def _texts(decoder: Decoder, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts)
    return pa.array([decoder.decode(flat[end - n : end].tolist()) for n, end in zip(counts.tolist(), ends.tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, decoded: bool = False) -> DataFrame:
    """docs (text, ...) as (row, ids), or (row, ids, decoded) with the texts that the ids stand for.

    ids: those of the model in ``path``, without begin and end.  Null and empty texts have none
    and are decoded to an empty text; texts of any length are encoded whole, in time that grows
    with their length.  Rows that repeat are encoded one by one; columns of docs may have any
    names; an empty table gives an empty one.
    """
    columns = docs.columns if keep is None else keep
    path = path or model_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder.of(path), Decoder.of(path)
        for batch in batches:
            ids = [encoder.encode(text.as_py()) for text in text_of(batch)]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            out = [batch.column(batch.schema.names.index("row")), lists] + ([_texts(decoder, flat, counts)] if decoded else [])
            yield pa.RecordBatch.from_arrays(out, ["row", "ids", "decoded"][: len(out)])

    rows = carried(docs, columns)
    schema = rows.select("row").schema.add("ids", ArrayType(IntegerType()))
    return rows.mapInArrow(encoded, schema.add("decoded", "string") if decoded else schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens (ids, ...) with a column decoded: the texts that the ids stand for; null ids have none.

    A null id is left out, one that the model does not have is an error.
    """
    path = path or model_path()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(path)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids")).to_pylist()
            if any(i is not None and not 0 <= i < len(decoder.shown) for x in ids if x for i in x):
                raise ValueError("an id is not one of the model's")
            found = [None if x is None else decoder.decode([i for i in x if i is not None]) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "decoded"])

    bound_batches(tokens.sparkSession)
    return tokens.mapInArrow(texts, StructType([*tokens.schema.fields, StructField("decoded", StringType())]))


def joined_ids(ids: Column) -> Column:
    """Decimal ids, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    found = encode(documents(spark, sf_dir), keep=["doc_id"], decoded=True)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(joined_ids(F.col("ids"))).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
