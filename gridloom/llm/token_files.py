"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents (ascending doc_id), each id in the vocabulary's minimum number of bits:

    magic | packed blocks | document starts, u64 | doc_ids, i64 | null flags, u8 | block offsets, u64 | footer

A block holds BLOCK ids (the last one fewer) and begins on a byte, so any id range is read by its blocks alone and
unpacked by numpy. Everything is little-endian; the footer's size is fixed, so a reader starts from the end.

The rows are dealt into doc_id ranges and sorted; each task encodes and writes its range as files of FILE_IDS ids or
more, under a name of its attempt, and renames them when complete. The content depends on the rows alone, so a
task that is run again writes the same files. Only a row per file reaches the driver.

Null texts count as empty and hold the end id alone. Rows without doc_id come last. Repeated doc_ids are ordered by
text, nulls first. No rows: no files. A doc_id that isn't an integer is a TypeError: the files hold it in 64 bits.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import shared_path
from .text import coded, pieces, ragged, string_bytes

MAGIC = b"GLTOKENS"
FOOTER = struct.Struct("<QQQQIII8s")
BLOCK = 8192
FILE_IDS = 1 << 26
PART_BYTES = 4 << 20
#: Ids that a reader unpacks at a time.
READ_IDS = 1 << 21
END_ID = 0


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    cells = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(cells.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    cells = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return cells.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class TokenWriter:
    def __init__(self, path: str, attempt: str, bits: int):
        self.fs, self.path = _locate(path)
        self.temporary, self.bits = f"{self.path}.{attempt}.tmp", bits
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.rest = len(MAGIC), np.zeros(0, np.int32)
        self.starts, self.docs, self.nulls, self.blocks, self.n = [], [], [], [], 0

    def add(self, doc_id: int | None, size: int) -> None:
        self.starts.append(self.n)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n += size

    def write(self, ids: np.ndarray, last: bool = False) -> None:
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            data = pack(ids[k : min(k + BLOCK, whole)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest = ids[whole:]

    def close(self) -> None:
        self.write(np.zeros(0, np.int32), last=True)
        for values, kind in ((self.starts, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.blocks, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.docs), len(self.blocks), self.n, self.bits, BLOCK, 1, MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        self.fs, name = _locate(path)
        self.file = self.fs.open_input_file(name)
        size = self.file.size()
        at, docs, blocks, self.n, self.bits, self.block, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        part = lambda kind, n: np.frombuffer(self._read_on(n * np.dtype(kind).itemsize), kind)
        self.file.seek(at)
        self.starts = np.append(part("<u8", docs), self.n).astype(np.int64)
        self.docs, self.nulls = part("<i8", docs), part("u1", docs).astype(bool)
        self.offsets = np.append(part("<u8", blocks), at).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self._read_on(n)

    def _read_on(self, n: int) -> bytes:
        return self.file.read(n)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file, from the blocks that hold them."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block + 1
        data = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        n = min(b * self.block, self.n) - a * self.block
        # blocks of BLOCK ids fill whole bytes at any width, so neighbours unpack as one
        return unpack(data, self.bits, n)[lo - a * self.block : hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


BLANK, ALPHA, DIGIT, OTHER, APOSTROPHE, WIDE = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[48:58], _CLASS[39], _CLASS[128:] = DIGIT, APOSTROPHE, WIDE
_CLASS[65:91] = _CLASS[97:123] = ALPHA

#: [before, at]: a GPT-2 style split always ends a token between bytes of these classes.
_CUT = np.zeros((6, 6), bool)
_CUT[1:, BLANK] = True
_CUT[ALPHA, [DIGIT, OTHER, APOSTROPHE]] = _CUT[DIGIT, [ALPHA, OTHER, APOSTROPHE]] = _CUT[OTHER, [ALPHA, DIGIT]] = True

_RARE_LEAD = np.zeros(256, bool)
_RARE_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_RARE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", *map(chr, range(0x2000, 0x2010)), "\u2028", "\u2029", "\u202f", *map(chr, range(0x205F, 0x2065)), "\u3000", "\ufeff")
_RARE_KEYS = np.array(sorted(int.from_bytes(c.encode().ljust(3, b"\0"), "big") >> 8 * (3 - len(c.encode())) for c in _RARE), np.uint32)


def _rare_documents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with a blank, or a character that some library takes for one, other than the ASCII blanks."""
    at = np.flatnonzero(_RARE_LEAD[data])
    if not len(at):
        return at
    x = data[at].astype(np.uint32)
    size = np.where(x < 0x80, 1, np.where(x < 0xE0, 2, 3))
    for k in (1, 2):
        more = size > k
        x[more] = x[more] << 8 | data[at[more] + k]
    return np.unique(np.searchsorted(offsets, at[np.isin(x, _RARE_KEYS)], "right") - 1)


def _holding(data: np.ndarray, offsets: np.ndarray, texts: list[bytes]) -> set[int]:
    """Documents that hold one of ``texts``."""
    whole, out = data.tobytes() if texts else b"", set()
    for text in texts:
        at = whole.find(text)
        while at >= 0:
            out.add(int(np.searchsorted(offsets, at, "right")) - 1)
            at = whole.find(text, at + 1)
    return out


def split_points(data: np.ndarray, offsets: np.ndarray, added: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pieces, first piece of each document and the end) of texts, for a GPT-2 style split.

    Pieces consist of whole tokens and encode to the same ids alone. They begin where a run of blanks begins, around a
    run's last blank if that isn't the space, and between ASCII letters, digits and other signs, but not behind an apostrophe (it may
    begin a contraction) nor beside other characters, whose class isn't looked up. Texts with rare blanks stay whole,
    and so do those that hold an added token's text, which the library takes out of a text first.
    """
    kind = _CLASS[data]
    cut = np.zeros(len(data), bool)
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    if len(data):
        # the last blank of a run is a token of its own if a non-blank follows and it isn't the space
        last = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & (data[:-1] != 32)
        last[heads[1:] - 1] = False
        cut[1:] = _CUT[kind[:-1], kind[1:]] | last
        cut[:-1] |= last
    for d in {*_rare_documents(data, offsets).tolist(), *_holding(data, offsets, added)}:
        cut[offsets[d] : offsets[d + 1]] = False
    cut[heads] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


#: Pieces of more bytes aren't remembered; pieces that a worker remembers (some 150 bytes each).
LONG_PIECE = 256
REMEMBER = 400_000


class LibraryEncoder:
    """The tokenizers library; a piece that isn't remembered goes through it, one that is has its ids by its bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [0], []
        for k in range(0, len(texts), 10_000):
            for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts[k : k + 10_000]], add_special_tokens=False):
                ids = x.ids
                flat += ids
                sizes.append(len(ids))
        return np.array(flat, np.int32), np.cumsum(sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        if len(self.row) > REMEMBER:
            self._forget()
        starts, first = split_points(data, offsets, self.added)
        # documents are adjacent, so each piece ends where the next one begins
        at = np.append(starts, len(data)).astype(np.int64)
        values, which = coded(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]))
        texts = values.to_pylist()
        row = np.fromiter((self.row.get(t, -1) for t in texts), np.int64, len(texts))
        new = np.flatnonzero(row < 0).tolist()
        # the long ones last, so that what is remembered is a prefix
        new.sort(key=lambda k: len(texts[k]) > LONG_PIECE)
        ids, ends = self._library([texts[k] for k in new])
        row[new] = len(self.offsets) - 1 + np.arange(len(new))
        store, store_ends = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + ends[1:]])
        out, ends_out = ragged(store, store_ends, row[which])
        kept = sum(len(texts[k]) <= LONG_PIECE for k in new)
        self.row.update((texts[k], int(row[k])) for k in new[:kept])
        self.offsets = store_ends[: len(self.offsets) + kept]
        self.ids = store[: self.offsets[-1]]
        return out, ends_out[first]


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, file_ids: int = FILE_IDS) -> list[tuple[str, int, int]]:
    """Writes the files; returns (path, ids before it, ids in it) for each, in order."""
    where, name = _locate(folder)
    where.create_dir(name, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, out, seq, done = _encoder(tokenizer), None, 0, []
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for lo, hi in pieces(offsets, PART_BYTES):
                ids, ends = own.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.diff(ends) + 1
                stops = np.cumsum(size)
                whole = np.full(int(stops[-1]), END_ID, np.int32)
                inner = np.ones(len(whole), bool)
                inner[stops - 1] = False
                whole[inner] = ids
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{seq:06d}.tok"
                    out = TokenWriter(path, str(task.taskAttemptId()), bits_for(own.size))
                for doc, n in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), size.tolist()):
                    out.add(doc, n)
                out.write(whole)
                if out.n >= file_ids:
                    out.close()
                    done.append((path, task.partitionId(), seq, out.n))
                    out, seq = None, seq + 1
        if out is not None:
            out.close()
            done.append((path, task.partitionId(), seq, out.n))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "seq", "n"), x)) for x in done], pa.schema([("path", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64())]))

    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}, not an integer")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.col("doc_id").asc_nulls_last()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    files = sorted(ordered.mapInArrow(write, "path string, part long, seq long, n long").collect(), key=lambda r: (r.part, r.seq))
    before = accumulate((r.n for r in files), initial=0)
    return [(r.path, b, r.n) for r, b in zip(files, before)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                for lo, hi in pieces(file.starts, READ_IDS):
                    base = int(file.starts[lo])
                    at = (file.starts[lo : hi + 1] - base).tolist()
                    data = memoryview(file.ids(base, int(file.starts[hi])).astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.docs[lo:hi].astype(np.int64), mask=file.nulls[lo:hi]), pa.array(file.starts[lo:hi] + before), pa.array(np.diff(file.starts[lo : hi + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p, b) for p, b, _ in files], "path string, start long")
    return listed.repartition(min(len(files), 10_000)).mapInArrow(read, schema)


def token_rows(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer, folder or shared_path(spark, "tokens")))
