"""BAM files as a DataFrame source and sink, decoded by array operations.

    register(spark); spark.read.format("bam").load(path).filter("mapq >= 10")
    spark.read.format("bam").option("kind", "targets").load(path)

A BAM file is a series of independently compressed blocks, and records run on over their
borders.  A cheap pass over the block headers (not the data) cuts the file into ranges of
blocks; where the first whole record of a range begins is known only to who has read the range
before, so ranges are chained by reading on: a task starts at the first block border from
which a run of plausible records follows, and reads until the first record past its end.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

RECORD_FIELDS = {
    "file_id": "INT", "rec_no": "BIGINT", "qname": "STRING", "flag": "INT", "tid": "INT", "pos0": "INT", "mapq": "SMALLINT", "cigar": "ARRAY<STRUCT<op: TINYINT, len: INT>>",
    "mate_tid": "INT", "mate_pos": "INT", "isize": "INT", "tags": "MAP<STRING, STRING>",
}
TARGETS = "file_id INT, tid INT, name STRING, len BIGINT"
TAG_TYPE = pa.map_(pa.string(), pa.string())
TARGET_TYPES = {"file_id": pa.int32(), "tid": pa.int32(), "name": pa.string(), "len": pa.int64()}
#: Records of an Arrow batch, and bytes of data that are read before they are decoded.
BATCH, RUN_BYTES = 8_192, 1 << 20
#: Bytes of data in a block that is written; fixed value: the bin of reads without a place, which readers here don't use.
BLOCK_DATA, NO_BIN = 60_000, 4680
#: Compressed bytes of a range; record numbers of range k begin at k times NUMBERS.
RANGE_BYTES, NUMBERS = 64 << 20, 1 << 40
#: Up to so many targets (some 50 bytes each) are broadcast to the records, else joined by a shuffle.
BROADCAST_TARGETS = 300_000
#: Files of a path, at most; fixed value: the flag of an unmapped read.
FILES, UNMAPPED = 1000, 4
#: So many records must look sound for a place to count as a record's beginning.
PLAUSIBLE = 3
#: Sizes of the numeric tag types.
TAG = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}


def block_size(head: bytes) -> int | None:
    """Whole size of a block from its first 18 bytes; None if it is not one."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= 12 + extra and at + 6 <= len(head):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC":
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def ranges(path: str, size: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """(begin, end) of runs of blocks; one range if the file is plain gzip."""
    total, begin, at, out = os.path.getsize(path), 0, 0, []
    with open(path, "rb") as f:
        while at < total:
            f.seek(at)
            n = block_size(f.read(18))
            if n is None:
                return [(0, total)]
            at += n
            if at - begin >= size:
                out.append((begin, at))
                begin = at
    return out + ([(begin, total)] if begin < total else [])


def inflated(path: str, begin: int, end: int, beyond: bool) -> Iterator[tuple[bytes, bool]]:
    """Data of the blocks from begin, and whether each lies past end; stops there unless ``beyond``."""
    with open(path, "rb") as f:
        f.seek(begin)
        head = f.read(18)
        if block_size(head) is None:  # plain gzip: one stream
            f.seek(begin)
            d = zlib.decompressobj(31)
            while chunk := f.read(1 << 20):
                while chunk:
                    yield d.decompress(chunk), False
                    chunk = d.unused_data
                    if d.eof:
                        d = zlib.decompressobj(31)
            return
        at = begin
        while len(head) == 18 and (beyond or at < end):
            n = block_size(head)
            if n is None:
                raise ValueError(f"{path}: no block at byte {at}")
            yield zlib.decompress(head + f.read(n - 18), 31), at >= end
            at += n
            head = f.read(18)


def header_of(path: str) -> tuple[list[tuple[str, int]], int]:
    """Targets (name, len), and how many bytes of data the header takes."""
    data = b""
    for block, _ in inflated(path, 0, 0, True):
        data += block
        try:
            if data[:4] != b"BAM\x01":
                raise ValueError(f"{path}: not a BAM file")
            at = 8 + struct.unpack_from("<i", data, 4)[0]
            count, at = struct.unpack_from("<i", data, at)[0], at + 4
            targets = []
            for _ in range(count):
                n = struct.unpack_from("<i", data, at)[0]
                targets.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
                at += 8 + n
            return targets, at
        except struct.error:
            continue
    raise ValueError(f"{path}: the header is cut off")


def _number(data: bytes, at: int) -> tuple[str, int]:
    """A tag's value of any numeric kind that begins with its kind, as text, and where it ends."""
    kind = chr(data[at])
    if kind == "B":
        form, size = TAG[chr(data[at + 1])]
        n = struct.unpack_from("<i", data, at + 2)[0]
        return ",".join(map(str, struct.unpack_from(f"<{n}{form}", data, at + 6))), at + 6 + n * size
    form, size = TAG[kind]
    return str(struct.unpack_from(f"<{form}", data, at + 1)[0]), at + 1 + size


def tags_at(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The tags of records as maps: in each step the next tag of all the records that have one.  Of tags of one name in a record the last counts.

    Texts and whole numbers go by arrays, reals and lists of numbers one by one.
    """
    raw, zeros = np.frombuffer(data, np.uint8), None
    records, at = np.arange(len(begins)), begins.astype(np.int64)
    found: list[tuple[np.ndarray, ...]] = []  # record, name, begin and length of the value in the pool
    pool, held = [raw], len(raw)
    while (more := at + 3 <= ends[records]).any():
        records, at = records[more], at[more]
        kind, begin = raw[at + 2], at + 3
        length, end = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        if (which := (kind == ord("Z")) | (kind == ord("H"))).any():
            zeros = np.append(np.flatnonzero(raw == 0), len(raw)) if zeros is None else zeros
            stop = zeros[np.searchsorted(zeros, begin[which])]
            length[which], end[which] = stop - begin[which], stop + 1
        which = kind == ord("A")
        length[which], end[which] = 1, begin[which] + 1
        for sort in np.unique(kind[end < 0]):
            which = kind == sort
            form, size = TAG.get(chr(sort), ("", 0))
            if form in tuple("bBhHiI"):
                values = raw[np.minimum(begin[which, None] + np.arange(size), len(raw) - 1)].view(np.dtype(form).newbyteorder("<"))[:, 0]
                texts, end[which] = pa.array(values).cast(pa.string()), begin[which] + size
            else:
                made = [_number(data, x) for x in (begin[which] - 1).tolist()]
                texts, end[which] = pa.array([x for x, _ in made], pa.string()), [x for _, x in made]
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            length[which], begin[which] = sizes, held + np.cumsum(sizes) - sizes
            pool.append(np.frombuffer(texts.buffers()[2], np.uint8)[: sizes.sum()])
            held += int(sizes.sum())
        if (end > ends[records]).any():
            raise ValueError("a tag runs on beyond its record")
        found.append((records, raw[at].astype(np.int64) << 8 | raw[at + 1], begin, length))
        at = end
    if not found:
        return pa.array([[]] * len(begins), TAG_TYPE)
    record, name, begin, length = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(record, kind="stable")
    record, name, begin, length = record[order], name[order], begin[order], length[order]
    last = np.lexsort((np.arange(len(name)), name, record))
    again = (record[last][1:] == record[last][:-1]) & (name[last][1:] == name[last][:-1])
    if again.any():
        first = np.maximum.accumulate(np.where(np.append(False, again), 0, np.arange(len(last))))  # of each name in its record
        into, latest = last[first], last
        begin[into], length[into] = begin[latest], length[latest]  # written in order, so the last one stays
        keep = np.ones(len(name), bool)
        keep[last[1:][again]] = False
        record, name, begin, length = record[keep], name[keep], begin[keep], length[keep]
    names = _texts(np.stack([name >> 8, name & 255], 1).astype(np.uint8).reshape(-1), 2 * np.arange(len(name)), np.full(len(name), 2))
    values = _texts(np.concatenate(pool), begin, length)
    return pa.MapArray.from_arrays(_offsets(np.bincount(record, minlength=len(begins))), names, values)


def sound(data: bytes, at: int, targets: int) -> int | None:
    """Where the next record begins if one can begin at ``at``; None if not; -1 if the data end before it is sure."""
    if at + 36 > len(data):
        return -1
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fixed = 32 + l_name + 4 * n_cigar + max(l_seq, 0) + (max(l_seq, 0) + 1) // 2
    if not (-1 <= tid < targets and -1 <= mate < targets and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0 and fixed <= size < 1 << 26):
        return None
    name_end = at + 35 + l_name
    if name_end < len(data) and (data[name_end] != 0 or any(x < 33 or x > 126 for x in data[at + 36 : name_end])):
        return None
    return at + 4 + size


def runs_of_records(path: str, begin: int, end: int, most: int) -> Iterator[tuple[bytes, list[int]]]:
    """Data and the places in them where records start (behind their size), of the records that begin in the blocks from begin up to end.

    A run has about ``most`` bytes of data: only the sizes of records are read here, one by one.
    """
    targets, skip = header_of(path)
    data, at, limit = b"", 0, None  # limit: where in data the blocks past end begin
    blocks = inflated(path, begin, end, True)

    def more() -> bool:
        """Reads on: whole runs as long as blocks lie before end, then block by block."""
        nonlocal data, at, limit
        rest = len(data) - at
        parts, held = [data[at:]], 0
        limit, at = None if limit is None else limit - at, 0
        while held < most and (block := next(blocks, None)) is not None:
            if block[1] and limit is None:
                limit = rest + held
            parts.append(block[0])
            held += len(block[0])
            if limit is not None:
                break
        data = b"".join(parts)
        return held > 0

    if begin == 0:
        while len(data) < skip and more():
            pass
        at = skip
    else:  # the first place from which records follow one another
        more()
        while True:
            place, found = at, 0
            while found < PLAUSIBLE:
                following = sound(data, place, len(targets))
                if following is None:
                    at, place, found = at + 1, at + 1, 0
                    if limit is not None and at >= limit:
                        return
                elif following < 0 or following > len(data):
                    if not more():
                        found = PLAUSIBLE if following > 0 or place > at or at >= len(data) else found
                        break
                    place, found = at, 0
                else:
                    place, found = following, found + 1
            break
    starts: list[int] = []
    while limit is None or at < limit:
        if at + 4 > len(data) or at + 4 + (size := struct.unpack_from("<i", data, at)[0]) > len(data):
            if starts:  # what lies before is given out before the data move on
                yield data, starts
                starts = []
            if not more():
                if at < len(data):
                    raise ValueError(f"{path}: the last record is cut off")
                return
            continue
        starts.append(at + 4)
        at += 4 + size
    if starts:
        yield data, starts


def _gathered(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all the stretches, one behind the other."""
    ends = np.cumsum(lengths)
    return raw[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _texts(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of Latin-1 as texts."""
    letters = _gathered(raw, starts, lengths)
    if len(letters) and letters.max() > 127:
        letters, ends = letters.tobytes(), np.cumsum(lengths).tolist()
        return pa.array([letters[e - n : e].decode("latin-1") for n, e in zip(lengths.tolist(), ends, strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(starts), _offsets(lengths).buffers()[1], pa.py_buffer(letters))


class Decoder:
    """Runs of records as Arrow batches: the fixed fields of all records at once, by array operations; the others of those records only that pass."""

    def __init__(self, columns: list[str], tests: list[tuple[str, str, object]]) -> None:
        self.columns, self.tests = columns, tests

    #: How a column compares with a value.
    COMPARE = {"=": np.equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "in": np.isin, "with": lambda x, bits: x & bits == bits, "without": lambda x, bits: x & bits == 0}

    def decode(self, data: bytes, starts: list[int], file_id: int, first: int) -> pa.RecordBatch:
        """The records of a run that pass, the first of the run numbered ``first``."""
        raw, at = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
        fields = raw[at[:, None] + np.arange(32)]
        word = lambda i: fields[:, 4 * i : 4 * i + 4].copy().view("<i4")[:, 0]
        half = lambda i: fields[:, i : i + 2].copy().view("<u2")[:, 0].astype(np.int32)
        fixed = {"tid": lambda: word(0), "pos0": lambda: word(1), "mapq": lambda: fields[:, 9].astype(np.int16), "flag": lambda: half(14), "mate_tid": lambda: word(5), "mate_pos": lambda: word(6), "isize": lambda: word(7)}
        passed = np.ones(len(at), bool)
        for column, how, value in self.tests:
            passed &= self.COMPARE[how](fixed[column](), value)
        number = first + np.flatnonzero(passed)
        at, fields = at[passed], fields[passed]
        name, cigar, letters = fields[:, 8].astype(np.int64), half(12).astype(np.int64), word(4).astype(np.int64)
        made = {
            "file_id": lambda: pa.array(np.full(len(at), file_id, np.int32)), "rec_no": lambda: pa.array(number), "qname": lambda: self._names(raw, at + 32, name - 1), "cigar": lambda: self._cigars(raw, at + 32 + name, cigar),
            "tags": lambda: tags_at(data, *self._tag_places(data, at, 32 + name + 4 * cigar + (letters + 1) // 2 + letters)),
        }
        return pa.RecordBatch.from_arrays([made[c]() if c in made else pa.array(fixed[c]()) for c in self.columns], self.columns)

    @staticmethod
    def _names(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return _texts(raw, starts, lengths)

    @staticmethod
    def _cigars(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
        steps = _gathered(raw, starts, 4 * counts).view("<u4")
        return pa.ListArray.from_arrays(_offsets(counts), pa.StructArray.from_arrays([pa.array((steps & 15).astype(np.int8)), pa.array((steps >> 4).astype(np.int32))], ["op", "len"]))

    @staticmethod
    def _tag_places(data: bytes, at: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(-4, 0)].view("<i4")[:, 0]
        return at + skip, at + sizes


class Range(InputPartition):
    def __init__(self, file_id: int, path: str, number: int, begin: int, end: int) -> None:
        self.file_id, self.path, self.number, self.begin, self.end = file_id, path, number, begin, end


class BamReader(DataSourceReader):
    """Filters on integers of a record are pushed down to its fixed fields: what they rule out is never decoded further."""

    PUSHED = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}
    FIXED = ("tid", "pos0", "mapq", "flag", "mate_tid", "mate_pos", "isize")

    def __init__(self, paths: list[str], targets: bool, size: int, columns: list[str], tests: list[tuple[str, str, object]]) -> None:
        self.paths, self.targets, self.size, self.columns, self.tests = paths, targets, size, columns, tests

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            fixed = not self.targets and len(getattr(x, "attribute", ())) == 1 and x.attribute[0] in self.FIXED
            if fixed and type(x) in self.PUSHED and getattr(x, "value", None) is not None:
                self.tests.append((x.attribute[0], self.PUSHED[type(x)], [y for y in x.value if y is not None] if isinstance(x, In) else x.value))
            elif not (fixed and isinstance(x, IsNotNull)):  # they never are null
                yield x

    def partitions(self) -> list[Range]:
        if self.targets:
            return [Range(i, p, 0, 0, 0) for i, p in enumerate(self.paths)]
        return [Range(i, p, k, *r) for i, p in enumerate(self.paths) for k, r in enumerate(ranges(p, self.size))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if self.targets:
            found = header_of(part.path)[0]
            for i in range(0, len(found), BATCH):
                some = found[i : i + BATCH]
                columns = ([part.file_id] * len(some), range(i, i + len(some)), *zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, TARGET_TYPES.values(), strict=True)], list(TARGET_TYPES))
            return
        decoder, n = Decoder(self.columns, self.tests), part.number * NUMBERS
        for data, starts in runs_of_records(part.path, part.begin, part.end, RUN_BYTES):
            for i in range(0, len(starts), BATCH):
                yield decoder.decode(data, starts[i : i + BATCH], part.file_id, n + i)
            n += len(starts)


class BamWriter(DataSourceArrowWriter):
    """A file for each task, with a header of its own; files get their names when all tasks are done."""

    def __init__(self, folder: str, targets: list[tuple[str, int]], overwrite: bool) -> None:
        self.folder, self.targets, self.overwrite = folder, targets, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        path = f"{self.folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        os.makedirs(self.folder, exist_ok=True)
        with open(path, "wb") as f:
            text = "".join(f"@SQ\tSN:{name}\tLN:{size}\n" for name, size in self.targets).encode()
            waiting = bytearray(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.targets)))
            for name, size in self.targets:
                waiting += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
            for batch in batches:
                waiting += records_bytes(batch)
                whole = len(waiting) // BLOCK_DATA * BLOCK_DATA
                for i in range(0, whole, BLOCK_DATA):
                    f.write(block_of(waiting[i : i + BLOCK_DATA]))
                del waiting[:whole]
            f.write(block_of(waiting) + block_of(b""))
        return Written(path)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        kept = [x.path for x in messages if x]
        if self.overwrite:
            for old in glob.glob(f"{self.folder}/*.bam"):
                os.remove(old)
        run = uuid.uuid4().hex[:8]
        for path in kept:
            os.rename(path, f"{self.folder}/{os.path.basename(path)[1:].rpartition('-')[0]}-{run}.bam")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        for x in messages:
            if x and os.path.exists(x.path):
                os.remove(x.path)


@dataclass
class Written(WriterCommitMessage):
    path: str


def block_of(data: bytes) -> bytes:
    """A block; of no data the one that ends a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


#: The fields before a record's name: its size, name, type and bounds; what stands where a column is missing or null, as of an unmapped read.
HEAD = np.dtype([("size", "<i4"), ("tid", "<i4"), ("pos0", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_tid", "<i4"), ("mate_pos", "<i4"), ("isize", "<i4")])
MISSING = {"tid": -1, "pos0": -1, "mapq": 255, "flag": UNMAPPED, "mate_tid": -1, "mate_pos": -1, "isize": 0}


def _latin(texts: pa.Array) -> pa.Array:
    """Texts as bytes of Latin-1."""
    raw = texts.cast(pa.binary())
    plain = len(raw) == 0 or raw.buffers()[2] is None or np.frombuffer(raw.buffers()[2], np.uint8).max(initial=0) < 128
    return raw if plain else pa.array([None if x is None else x.encode("latin-1") for x in texts.to_pylist()], pa.binary())


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of lists one behind the other, and where each list begins and ends; null is empty."""
    if column.null_count:
        column = column.take(pa.array(np.arange(len(column))))  # nothing is left behind a null
    return column.values, column.offsets.to_numpy()


def _pieces(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Bytes cut at offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data])


def _put(head: np.ndarray, field: str, values: np.ndarray) -> None:
    """Sets a field; values that it cannot hold are an error."""
    most = np.iinfo(head.dtype[field])
    if len(values) and (values.min() < most.min or values.max() > most.max):
        raise ValueError(f"{field} is beyond what a BAM record holds")
    head[field] = values


def records_bytes(batch: pa.RecordBatch) -> memoryview:
    """Records with their sizes, without letters, by array operations; tags, if any, are texts.  What is missing or null is as of an unmapped read."""
    n, given = batch.num_rows, {name: batch.column(name) for name in batch.schema.names}
    if n == 0:
        return memoryview(b"")
    head, parts = np.zeros(n, HEAD), []
    for field, other in MISSING.items():
        _put(head, field, given[field].cast(pa.int64()).fill_null(other).to_numpy() if field in given else np.array([other]))
    name = _latin(given["qname"].fill_null("*") if "qname" in given else pa.array(["*"] * n))
    _put(head, "l_name", pc.binary_length(name).to_numpy() + 1)
    parts += [name, pa.scalar(b"\0", pa.binary())]
    if "cigar" in given:
        steps, offsets = _lists(given["cigar"])
        op, length = (steps.field(x) for x in ("op", "len"))
        if steps.null_count or op.null_count or length.null_count:
            raise ValueError("a step of a CIGAR is null")
        op, length = op.to_numpy().astype(np.int64), length.to_numpy().astype(np.int64)
        if len(op) and (min(op.min(), length.min()) < 0 or op.max() > 15 or length.max() >= 1 << 28):
            raise ValueError("a step of a CIGAR is beyond what a BAM record holds")
        _put(head, "n_cigar", np.diff(offsets))
        parts.append(_pieces(4 * offsets, pa.py_buffer((length << 4 | op).astype("<u4"))))
    if "tags" in given:
        entries, offsets = _lists(given["tags"])
        key, value = (_latin(entries.field(i)) for i in (0, 1))
        if key.null_count or value.null_count:
            raise ValueError("a tag is null")
        texts = pc.binary_join_element_wise(key, pa.scalar(b"Z", pa.binary()), value, pa.scalar(b"\0", pa.binary()), pa.scalar(b"", pa.binary()))
        places = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        parts.append(_pieces(places[offsets], texts.buffers()[2] or pa.py_buffer(b"")))
    head["bin"] = NO_BIN
    _put(head, "size", HEAD.itemsize - 4 + 1 + sum(pc.binary_length(x).to_numpy().astype(np.int64) for x in parts if isinstance(x, pa.Array)))
    whole = pc.binary_join_element_wise(_pieces(HEAD.itemsize * np.arange(n + 1), pa.py_buffer(head)), *parts, pa.scalar(b"", pa.binary()))
    return memoryview(whole.buffers()[2])[: int(head["size"].sum(dtype=np.int64)) + 4 * n]


class BamSource(DataSource):
    """Reading: path (a file, a folder or a pattern that all executors see), kind (records or targets), rangeBytes,
    columns (names with commas: only these are decoded), withFlags and withoutFlags (bits of flag that all are set, or none).

    Writing: path (a folder), targets (JSON: a list of names and lengths, in order of tid).
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        if self.options.get("kind") == "targets":
            return TARGETS
        return ", ".join(f"{c} {RECORD_FIELDS[c]}" for c in self._columns())

    def _columns(self) -> list[str]:
        wanted = self.options.get("columns")
        chosen = [c for c in RECORD_FIELDS if wanted is None or c in wanted.replace(" ", "").split(",")]
        return [c for c in chosen if c != "tags" or self.options.get("tags") != "no"]

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema: StructType) -> BamReader:
        where = self._folder()
        paths = sorted(glob.glob(os.path.join(where, "*.bam") if os.path.isdir(where) else where))
        if not paths:
            raise FileNotFoundError(where)
        tests = [("flag", how, int(self.options[option])) for how, option in (("with", "withFlags"), ("without", "withoutFlags")) if option in self.options]
        return BamReader(paths, self.options.get("kind") == "targets", int(self.options.get("rangeBytes", RANGE_BYTES)), self._columns(), tests)

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(self._folder(), [(name, size) for name, size in json.loads(self.options["targets"])], overwrite)


#: What scaffolding needs of a record.
KEPT = ("file_id", "rec_no", "qname", "flag", "tid", "pos0", "mapq", "cigar")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters go down to it only where the session lets them."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def renumbered(records_: DataFrame) -> DataFrame:
    """Record numbers without holes from range to range, so that runs of names go on over their borders.

    Counts the records of each range first; the table of counts has a row for each range.
    """
    number = F.floor(F.col("rec_no") / NUMBERS)
    counts = records_.groupBy(F.col("file_id").alias("of_file"), number.alias("of_range")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of_file").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of_file", "of_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    joined = records_.join(starts, (F.col("file_id") == F.col("of_file")) & (number == F.col("of_range")))
    return joined.withColumn("rec_no", F.col("start") + F.col("rec_no") % NUMBERS).select(*records_.columns)


def read_bam(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records, or with kind="targets" the files' targets (options: see BamSource).  For large files decode once, with to_parquet()."""
    register(spark)
    return spark.read.format("bam").options(**options).load(path)


def by_name(records_: DataFrame, targets: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records with tid as in contigs (tid, name): files may list their targets in another order.

    Unmapped records may be without a tid; a mapped record on a contig that ``contigs`` does not have is an error.
    """
    own = targets.select("file_id", "tid", "name").join(contigs.selectExpr("name", "tid AS known"), "name", "left")
    joined = records_.join(F.broadcast(own) if own.count() <= BROADCAST_TARGETS else own, ["file_id", "tid"], "left")
    stray = (F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("tid") >= 0) & F.col("known").isNull()
    message = F.concat(F.lit("a read lies on a contig that is not in the list: "), F.coalesce("name", F.col("tid").cast("string")))
    tid = F.when(stray, F.raise_error(message).cast("int")).otherwise(F.col("known"))
    return joined.withColumn("tid", tid).select(*records_.columns)


def write_bam(records_: DataFrame, targets: DataFrame, path: str) -> None:
    """Records (qname, flag, tid, pos0, mapq, cigar, ...) as BAM files in a folder, one for each partition.

    targets (tid, name, len), tids without holes from 0 on, are the header of each file, as the format wants it.
    """
    header = [(r["name"], r["len"]) for r in targets.select("tid", "name", "len").orderBy("tid").collect()]  # every file holds it whole
    known = [c for c in RECORD_FIELDS if c in records_.columns and c not in ("file_id", "rec_no")]
    register(records_.sparkSession)
    records_.select(*known).write.format("bam").option("targets", json.dumps(header)).mode("overwrite").save(path)


def _numbered(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """What several paths hold, each of which may be a folder or a pattern, with file ids that go on from path to path."""
    return reduce(DataFrame.unionByName, [read_bam(spark, path, **options).withColumn("file_id", F.col("file_id") + FILES * i) for i, path in enumerate(paths)])


def to_parquet(spark: SparkSession, paths: str | list[str], out: str, **options: str) -> None:
    """Decodes once: later runs read only the columns they need.  The targets of each file are kept beside the records."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    _numbered(spark, paths, columns=",".join(KEPT), **options).select(*KEPT).write.mode("overwrite").parquet(f"{out}/records")
    _numbered(spark, paths, kind="targets").write.mode("overwrite").parquet(f"{out}/targets")


def from_parquet(spark: SparkSession, out: str, kind: str = "records") -> DataFrame:
    """What to_parquet() wrote: records with numbers without holes, or the files' targets."""
    table = spark.read.parquet(f"{out}/{kind}")
    return renumbered(table) if kind == "records" else table
