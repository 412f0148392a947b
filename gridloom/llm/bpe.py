"""Byte-level BPE with a hierarchical-bitmap rank queue.

The queue has a bucket per merge rank; a bucket holds positions of a linked list of tokens. A three-level bitmap
marks the buckets in use, and find-first-set on it picks the next rank. Entries aren't removed when a
merge changes a pair: a position whose pair now has another rank is skipped as stale.

One queue serves all pre-tokens of a batch that aren't known yet: they lie side by side in one list without
pairs across their borders, and a bucket is merged as a whole with numpy. That equals merging each pre-token
alone, leftmost lowest rank first, unless a merge makes a pair of a lower rank than its own; pre-tokens in which
that happens are merged again one position at a time. Time is linear in a pre-token's length up to the bitmap,
so a pre-token of millions of bytes is no special case.

A null text is an empty one: no ids, no bytes. Rows are independent; the extra columns are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .text import PieceEncoder, gathered, pieces, ragged, release, string_bytes

NONE = 1 << 30
#: Bytes of text that are encoded at a time.
PART_BYTES = 6 << 20


class RankBitmap:
    """Three levels of 64-bit words over the ranks below 2**18."""

    def __init__(self):
        self.low = [0] * 4096
        self.mid = [0] * 64
        self.top = 0

    def set(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop_first(self) -> int:
        """The lowest rank, cleared; -1 if there is none."""
        if not self.top:
            return -1
        t = (self.top & -self.top).bit_length() - 1
        m = (t << 6) + ((self.mid[t] & -self.mid[t]).bit_length() - 1)
        word = self.low[m]
        rank = (m << 6) + ((word & -word).bit_length() - 1)
        self.low[m] = word & (word - 1)
        if not self.low[m]:
            self.mid[t] &= self.mid[t] - 1
            if not self.mid[t]:
                self.top &= self.top - 1
        return rank


class Vocabulary:
    """Ranks of a tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.ranks.values()) >= 1 << 18:
            raise ValueError("ranks of 2**18 or more")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        found = []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    found.append((a << 18 | b, rank))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        self.keys, self.merged = pairs[order, 0], pairs[order, 1].astype(np.int32)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.text = np.frombuffer(b"".join(self.tokens), np.uint8)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 18 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE).astype(np.int32)

    def encode_piece(self, piece: bytes) -> list[int]:
        """One pre-token, one merge at a time: the lowest rank, its leftmost position first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        token, n, tokens = self.byte[np.frombuffer(piece, np.uint8)].tolist(), len(piece), self.tokens
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [NONE] * n
        bitmap, buckets = RankBitmap(), {}

        def push(p: int) -> None:
            q = after[p]
            rank_at[p] = r = self.ranks.get(tokens[token[p]] + tokens[token[q]], NONE) if q < n else NONE
            if r != NONE:
                if r not in buckets:
                    buckets[r] = []
                heappush(buckets[r], p)
                bitmap.set(r)

        for p in range(n - 1):
            push(p)
        while (r := bitmap.pop_first()) >= 0:
            bucket = buckets[r]
            p = heappop(bucket)
            if bucket:
                bitmap.set(r)
            if rank_at[p] != r:
                continue  # stale
            q = after[p]
            token[p], rank_at[q] = r, NONE
            after[p] = far = after[q]
            if far < n:
                before[far] = p
            push(p)
            if before[p] >= 0:
                push(before[p])
        out, p = [], 0
        while p < n:
            out.append(token[p])
            p = after[p]
        return out

    def encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many pre-tokens, with one rank queue."""
        whole = [self.ranks.get(w, -1) for w in words]
        todo = [k for k, r in enumerate(whole) if r < 0]
        size = np.ones(len(words), np.int64)
        parts: list[np.ndarray | None] = [None] * len(words)
        if todo:
            data = np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)
            stops = np.cumsum([len(words[k]) for k in todo])
            token, alive, odd = self._merge(data, stops)
            begins = np.concatenate([[0], stops[:-1]])
            kept = np.concatenate([[0], np.cumsum(alive)])
            ids = token[alive]
            for k, a, b in zip(todo, kept[begins].tolist(), kept[stops].tolist()):
                parts[k] = ids[a:b]
            for k in np.flatnonzero(odd).tolist():
                parts[todo[k]] = np.array(self.encode_piece(words[todo[k]]), np.int32)
            for k in todo:
                size[k] = len(parts[k])
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(offsets[-1]), np.int32)
        single = np.array(whole, np.int32)
        out[offsets[:-1][single >= 0]] = single[single >= 0]
        for k in todo:
            out[offsets[k] : offsets[k + 1]] = parts[k]
        return out, offsets

    def _merge(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        token = self.byte[data].copy()
        after = np.arange(1, n + 1, dtype=np.int64)
        after[stops - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[np.concatenate([[0], stops[:-1]])] = -1
        rank_at = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after < n)
        rank_at[inner] = self.lookup(token[inner], token[inner + 1])
        alive = np.ones(n, bool)
        odd = np.zeros(len(stops), bool)
        bitmap, buckets = RankBitmap(), {}

        def push(at: np.ndarray) -> None:
            ranks = rank_at[at]
            some = ranks != NONE
            if not some.all():
                at, ranks = at[some], ranks[some]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                r = int(ranks[a])
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    bitmap.set(r)

        push(inner)
        while (r := bitmap.pop_first()) >= 0:
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.sort(np.concatenate(held))
            at = at[rank_at[at] == r]  # the others are stale
            if len(at) > 1:
                chained = after[at[:-1]] == at[1:]  # aaa: the left pair takes the middle token
                if chained.any():
                    head = np.flatnonzero(np.concatenate([[True], ~chained]))
                    place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                    at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            right = far < n
            low = np.zeros(0, np.int64)
            old = self.lookup(np.full(int(right.sum()), r), token[far[right]]) < r
            if old.any():
                low = at[right][old]
            token[at], alive[gone], rank_at[gone], after[at] = r, False, NONE, far
            before[far[right]] = at[right]
            rank_at[at] = NONE
            some = at[right]
            rank_at[some] = self.lookup(token[some], token[far[right]])
            left = before[at]
            left = left[left >= 0]
            rank_at[left] = self.lookup(token[left], token[after[left]])
            changed = np.union1d(some, left)
            push(changed)
            below = changed[rank_at[changed] < r]
            for p in (*low.tolist(), *below.tolist()):
                odd[np.searchsorted(stops, p, "right")] = True
        return token, alive, odd


class Encoder(PieceEncoder):
    """Vocabulary, split pattern and remembered pre-tokens of one worker."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = v = Vocabulary(path)
        super().__init__(regex.compile(pattern).findall, lambda words: v.encode_pieces([w.encode() for w in words]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts whose ids these are."""
        v = self.vocabulary
        data, ends = ragged(v.text, v.start, ids)
        return data, ends[offsets]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """large_binary rows over one buffer."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced by its ids, packed as little-endian unsigned 32-bit integers, and ``n_tokens``.

    ``decoded`` names a further column: the ids decoded again, as bytes. An added column whose name is taken gets an underscore in front.
    """
    rest = [c for c in docs.columns if c != "text"]
    names = fresh(rest, "n_tokens", ids, *([decoded] if decoded else []))
    more = [T.StructField(name, T.BinaryType() if k else T.LongType()) for k, name in enumerate(names)]
    schema = T.StructType([docs.schema[c] for c in rest] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in gathered(batches, PART_BYTES):
            column = batch.column(len(rest))
            _, offsets = string_bytes(column)
            for lo, hi in pieces(offsets, PART_BYTES):
                found, ends = own.encode(column.slice(lo, hi - lo).fill_null("").to_pylist())
                out = [*(c.slice(lo, hi - lo) for c in batch.columns[: len(rest)]), pa.array(np.diff(ends)), _binary(found.astype("<u4").view(np.uint8), 4 * ends)]
                if decoded:
                    out.append(_binary(*own.decode(found, ends)))
                yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) and len(c) and c.nbytes < 1 << 30 else c for c in out], names=schema.names)
        own.forget()
        release()

    return docs.select(*rest, "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with packed ids replaced by their text; bytes that aren't UTF-8 become U+FFFD."""
    rest = [c for c in rows.columns if c != ids]
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            packed = batch.column(len(rest)).to_pylist()
            texts = [own.decode(x := np.frombuffer(b or b"", "<u4").astype(np.int64), np.array([0, len(x)]))[0].tobytes().decode("utf-8", "replace") for b in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*rest, ids).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    rows = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
