"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A data file is a run of records: length of the payload (8 bytes), masked checksum of the
length (4), payload, masked checksum of the payload (4); little-endian, checksums CRC-32C,
``mask(c) = rotate_right(c, 15) + 0xa282ead8``.  A payload is the document's id (8 bytes), a
flag that it has one (1), the bytes per token (1), the number of tokens (4) and the tokens.
The index beside it holds for each record its place, its size (8 bytes each) and its number
of tokens (4), so that any record can be read by itself.

Documents are dealt by ranges of their id and sorted, so files follow each other in order of
id and each task writes one file.  A task writes under a name of its own and renames the file
when it is whole, so a repeated task leaves one file.  Files go through the file system of
the folder's URI, never to a task's machine.

Encoding looks up pieces: the tokenizer's pattern never joins a character to white space that
follows, nor a letter to a mark that follows (but for the apostrophe), so a text may be cut there.
Arrow numbers the distinct pieces of a slice of texts, each Python worker encodes a piece once, and
the tokens of all pieces are then gathered by number; the table of pieces has a fixed largest size.

Defined results: null text is empty, an empty text has the end token only; null ids come
first and read back as null; equal ids are ordered by text; repeated rows are records of their
own; an empty table gives no record.  Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import words as w
from claimloom.session import durable

END = 0
_PIECES = 1_000_000
_SLICE_BYTES = 8 << 20
_HEAD = "<qBBI"
_BLOCK = 256
_INDEX = np.dtype([("place", "<u8"), ("size", "<u8"), ("tokens", "<u4")])


def _checksum_tables() -> tuple[np.ndarray, np.ndarray]:
    """The step by one byte, and by _BLOCK zero bytes for each of a checksum's four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0x82F63B78), step >> 1)
    far = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(_BLOCK):
        far = step[far & 0xFF] ^ (far >> 8)
    return step, far


_STEP, _FAR = _checksum_tables()


def checksums(records: list[bytes]) -> np.ndarray:
    """CRC-32C of records of four bytes at least, all at once.

    Zeros in front of the data and a start value within its first four bytes leave the checksum
    as it is, so records are filled to whole blocks, the blocks handled side by side and
    then joined in order.
    """
    if not records:
        return np.zeros(0, np.uint32)
    blocks = np.array([-(-len(x) // _BLOCK) for x in records])
    first = np.cumsum(blocks) - blocks
    data = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    for x, a, n in zip(records, first, blocks, strict=True):
        end = (a + n) * _BLOCK
        data[end - len(x) : end] = np.frombuffer(x, np.uint8)
        data[end - len(x) : end - len(x) + 4] ^= 0xFF
    columns = np.ascontiguousarray(data.reshape(-1, _BLOCK).T)
    own = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        own = _STEP[(own ^ column) & 0xFF] ^ (own >> np.uint32(8))
    total = np.zeros(len(records), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    falling = blocks[order]
    for j in range(int(falling[0])):
        active = order[: np.searchsorted(-falling, -j, "left")]
        now = total[active]
        moved = _FAR[0][now & 0xFF] ^ _FAR[1][(now >> 8) & 0xFF] ^ _FAR[2][(now >> 16) & 0xFF] ^ _FAR[3][now >> 24]
        total[active] = moved ^ own[first[active] + j]
    return ~total


def masked(sums: np.ndarray) -> np.ndarray:
    return ((sums >> np.uint32(15)) | (sums << np.uint32(17))) + np.uint32(0xA282EAD8)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    own = np.zeros(256, bool)
    for low, high in ranges:
        own[low : high + 1] = True
    return own


#: White space (1) and marks (2); what may stand before them at a cut, four times these bits.
_CLASS = (
    _bytes((9, 13), (32, 32)) * 1
    + _bytes((33, 38), (40, 47), (58, 64), (91, 96), (123, 126)) * 2
    + _bytes((33, 126), (128, 255)) * 4
    + _bytes((65, 90), (97, 122)) * 8
).astype(np.uint8)
_UNSURE = _bytes((0xC2, 0xC2), (0x80, 0x81), (0x9A, 0x9A))


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut: before white space after none, or a mark after a letter.

    Some white space beyond ASCII ends in the bytes of other characters; there is no cut after those.
    """
    kind = _CLASS[data]
    at = np.flatnonzero(kind[1:] & (kind[:-1] >> 2)) + 1
    return at[(data[at - 1] < 128) | ~_UNSURE[data[at - 2]]]


class Encoder:
    """Texts to the bytes of their token ids."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = self.tokenizer.get_added_tokens_decoder().values()
        literals = sorted((x.content for x in added if x.content), key=len, reverse=True)  # the longest at a place counts
        self.literals = "|".join(map(re.escape, literals))
        self.alone = not any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.forget()

    def forget(self) -> None:
        """Piece k of ``known`` has the tokens ``first[k]`` to ``first[k + 1]`` of ``tokens``."""
        self.known: dict[str, int] = {}
        self.first, self.tokens, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.type), 0

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        if len(self.known) > _PIECES or self.used > 16 * _PIECES:
            self.forget()
        numbers = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers
        new = [pieces[i] for i in missing.tolist()]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        n = len(self.known)
        numbers[missing] = np.arange(n, n + len(new))
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        ends = self.used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if n + len(new) >= len(self.first):
            self.first = np.resize(self.first, 2 * (n + len(new)))
        if ends[-1] > len(self.tokens):
            self.tokens = np.resize(self.tokens, 2 * ends[-1])
        self.first[n + 1 : n + len(new) + 1] = ends
        self.tokens[self.used : ends[-1]] = np.fromiter(itertools.chain.from_iterable(found), self.type, ends[-1] - self.used)
        self.used = int(ends[-1])
        return numbers

    def uncut(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of ``data`` that must be pieces: the added tokens, each inside its text."""
        if not self.literals:
            return
        found = pc.fill_null(pc.match_substring_regex(texts, self.literals), False)
        pattern = re.compile(self.literals.encode())
        for row in np.flatnonzero(found.to_numpy(zero_copy_only=False)).tolist():
            first, end = int(offsets[row]), int(offsets[row + 1])
            if not self.alone:
                yield first, end
                continue
            for x in pattern.finditer(data[first:end].tobytes()):
                yield first + x.start(), first + x.end()

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        data, offsets = w.text_bytes(texts)
        begin = np.zeros(len(data) + 1, bool)
        begin[_cuts(data)] = True
        for a, b in self.uncut(texts, data, offsets):
            begin[a + 1 : b] = False
            begin[[a, b]] = True
        begin[offsets] = True  # a piece ends with its text
        begin = np.flatnonzero(begin)
        pieces = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(data)).dictionary_encode()
        numbers = self.numbers(pieces.dictionary.to_pylist())
        own, sizes = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        numbers = pieces.indices.to_numpy()
        sizes = sizes[numbers]
        ends = np.cumsum(sizes)
        place = np.repeat((own[numbers] - ends + sizes).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        tokens = self.tokens[place].tobytes()
        at = np.concatenate(([0], ends))[np.searchsorted(begin, offsets)] * self.width
        return [tokens[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@functools.cache
def encoder_of(tokenizer_file: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(tokenizer_file)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(x)) for x in payloads]
    heads, tails = masked(checksums(lengths)), masked(checksums(payloads))
    return [b"".join((n, struct.pack("<I", h), x, struct.pack("<I", t))) for n, h, x, t in zip(lengths, heads, payloads, tails, strict=True)]


def payload_of(frame: bytes) -> bytes:
    return frame[12:-4]


def check(found: list[bytes]) -> None:
    """Raise if a frame is not whole."""
    lengths = [x[:8] for x in found]
    if any(struct.unpack("<Q", n)[0] != len(x) - 16 for n, x in zip(lengths, found, strict=True)):
        raise ValueError("a record's length does not match its index")
    said = np.array([struct.unpack("<I", x[8:12]) + struct.unpack("<I", x[-4:]) for x in found], np.uint32).reshape(-1, 2)
    if (said[:, 0] != masked(checksums(lengths))).any() or (said[:, 1] != masked(checksums([payload_of(x) for x in found]))).any():
        raise ValueError("a record's checksum does not match")


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a URI of Hadoop's: file, hdfs, viewfs, s3a, gs or abfss, as far as Arrow is built with it."""
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


_FILES = "part int, n_records long, n_tokens long"


def write(docs: DataFrame, folder: str, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", end: int = END) -> DataFrame:
    """Write all documents below ``folder``; returns one row for each file, in order of ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = encoder_of(tokenizer_file)
        last = np.array([end], encoder.type).tobytes()
        files, place, records, tokens = None, 0, 0, 0
        for batch in batches:
            for at, some in w.slices(batch.column(1), _SLICE_BYTES):
                if files is None:
                    system, base = _file_system(folder)
                    system.create_dir(base, recursive=True)
                    names = [f"{base}/{kind}-{part:06d}" for kind in ("tokens", "index")]
                    files = [system.open_output_stream(f"{x}.{attempt}") for x in names]
                ids = batch.column(0).slice(at, len(some)).to_pylist()
                encoded = [x + last for x in encoder.encode(some)]
                counts = [len(x) // encoder.width for x in encoded]
                made = frames([struct.pack(_HEAD, i or 0, i is not None, encoder.width, n) + x for i, n, x in zip(ids, counts, encoded, strict=True)])
                index = np.zeros(len(made), _INDEX)
                index["size"] = [len(x) for x in made]
                index["place"] = place + np.cumsum(index["size"]) - index["size"]
                index["tokens"] = counts
                files[0].write(b"".join(made))
                files[1].write(index.tobytes())
                place, records, tokens = place + int(index["size"].sum()), records + len(made), tokens + sum(counts)
        if files is not None:
            for x, name in zip(files, names, strict=True):
                x.close()
                system.move(f"{name}.{attempt}", name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([records]), pa.array([tokens])], ["part", "n_records", "n_tokens"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return durable(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _FILES))


def read_record(folder: str, part: int, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a file by its index: the id and the tokens."""
    system, base = _file_system(folder)
    with system.open_input_file(f"{base}/index-{part:06d}") as file:
        entry = np.frombuffer(file.read_at(_INDEX.itemsize, k * _INDEX.itemsize), _INDEX)[0]
    with system.open_input_file(f"{base}/tokens-{part:06d}") as file:
        frame = file.read_at(int(entry["size"]), int(entry["place"]))
    check([frame])
    return parse(payload_of(frame))


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    number, has_id, width, n = struct.unpack_from(_HEAD, payload)
    return number if has_id else None, np.frombuffer(payload, f"<u{width}", n, struct.calcsize(_HEAD))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, checksums verified.

    ``start`` adds up the files before and the records before; there is one row a file, and each
    file is read by one task, a few megabytes at a time.
    """
    rows = sorted(tuple(r) for r in files.collect())
    before = np.cumsum([0, *[n for _, _, n in rows]]).tolist()
    named = spark.createDataFrame([(part, start) for (part, _, _), start in zip(rows, before, strict=False)], "part int, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for part, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{base}/index-{part:06d}") as file:
                    index = np.frombuffer(file.read(), _INDEX)
                groups = np.flatnonzero(np.diff(index["place"] // (4 << 20), prepend=-1))
                with system.open_input_stream(f"{base}/tokens-{part:06d}") as file:
                    for a, b in zip(groups, [*groups[1:], len(index)], strict=True):
                        sizes = index["size"][a:b].astype(np.int64)
                        data = file.read(int(sizes.sum()))
                        ends = np.cumsum(sizes)
                        found = [data[e - s : e] for s, e in zip(sizes, ends, strict=True)]
                        check(found)
                        parsed = [parse(payload_of(x)) for x in found]
                        counts = np.array([len(x) for _, x in parsed], np.int64)
                        sums = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in parsed]
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i for i, _ in parsed], pa.int64()), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = named.repartitionByRange(max(1, len(rows)), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, shared: str) -> str:
    """A folder's name below ``shared``, as a URI: a path without a scheme is one of Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared}/tokens-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
