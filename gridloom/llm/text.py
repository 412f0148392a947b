"""Vectorised views of Arrow string columns: bytes, document offsets, word spans, distinct words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the blanks [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _libc = None


def release() -> None:
    """Hands freed memory back to the system: workers outlive a task, and others need it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size`` bytes or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts. No copy but for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; a longer document is a range of its own."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the end) of the maximal runs of bytes in ``inside``."""
    mask = inside[data]
    before = np.empty_like(mask)
    after = np.empty_like(mask)
    if len(mask):
        before[0], before[1:] = False, mask[:-1]
        after[-1], after[:-1] = False, mask[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(mask))]
        before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> pa.Array:
    """The (lower-cased) bytes of each span. The spans are in order and don't overlap."""
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    body = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[body] if lower else np.ascontiguousarray(body))])


def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the distinct values, the number of each value among them), told apart by their bytes."""
    found = values.dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def ragged(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` of a ragged array, one after the other, and their offsets."""
    begin = offsets[at]
    size = offsets[at + 1] - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat(begin - ends[:-1], size)
    shift += np.arange(len(shift))
    return values[shift], ends


#: Pieces that a worker remembers from one call to the next (some 50 MB).
REMEMBER = 200_000


class PieceEncoder:
    """Ids of texts that split into independently encoded pieces; each piece is encoded once while remembered."""

    def __init__(self, split: Callable[[str], list[str]], encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.split, self.encode_pieces = split, encode_pieces
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        number, known = self.number, len(self.number)
        found = []
        for text in texts:
            words = self.split(text)
            try:
                found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            except KeyError:
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        if len(number) > known:
            ids, offsets = self.encode_pieces(list(number)[known:])
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        at = np.concatenate(found or [np.zeros(0, np.int32)])
        out, ends = ragged(self.ids, self.offsets, at)
        result = out, ends[np.cumsum([0, *map(len, found)])]
        if len(number) > REMEMBER:
            self._keep(np.unique(at)[-REMEMBER:])
        return result

    def _keep(self, used: np.ndarray) -> None:
        names = list(self.number)
        self.ids, self.offsets = ragged(self.ids, self.offsets, used)
        self.number = {names[k]: i for i, k in enumerate(used.tolist())}
