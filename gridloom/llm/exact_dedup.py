"""Exact deduplication on a cuckoo-filter index of live digests.

Texts are normalised by deleting blanks and reduced to their SHA-256 at the scan, so no text is shuffled. Each
scan task folds its rows into an index (pre-aggregation: a group of copies leaves a task as one row, however large
it is); the entries are then dealt by digest, and one index per partition merges them.

``CuckooIndex`` keeps an 8-bit tag per slot, four slots a bucket, and beside each slot the entry itself, its digest
included: a tag hit is verified against the digest in the bucket, deletion takes out exactly the digest asked
for, and an insertion that finds no slot doubles the table and places all entries anew from their stored keys.

Null texts count as empty. Rows without doc_id order after the others; a doc_id may be of any type that has an order. Exact repeats of a row
are told apart by their place in the files (``common.placed``), so exactly one row of a group is kept, however the files are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, placed, without
from .text import release, string_bytes

SLOTS = 4
MAX_KICKS = 200
#: Entries of one index before a scan task hands them on and starts anew (about 100 MB).
SCAN_ENTRIES = 200_000
BLANKS = b" \t\n\x0b\x0c\r"


class CuckooIndex:
    """Digest -> value for digests of 16 bytes or more, with insertion, replacement and deletion."""

    def __init__(self, buckets: int = 1 << 10):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = bytearray(buckets * SLOTS)  # 0: free
        self.entries: list[tuple[bytes, object] | None] = [None] * (buckets * SLOTS)
        self.n = 0
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = digest[0] or 1
        one = int.from_bytes(digest[1:9], "little") & self.mask
        return tag, one, self._other(one, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995 + 1)) & self.mask

    def _find(self, digest: bytes) -> int:
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[at] == tag and self.entries[at][0] == digest:
                    return at
        return -1

    def get(self, digest: bytes, default=None):
        at = self._find(digest)
        return default if at < 0 else self.entries[at][1]

    def put(self, digest: bytes, value) -> None:
        at = self._find(digest)
        if at >= 0:
            self.entries[at] = (digest, value)
        else:
            self._insert((digest, value))

    def delete(self, digest: bytes) -> bool:
        at = self._find(digest)
        if at < 0:
            return False
        self.tags[at], self.entries[at] = 0, None
        self.n -= 1
        return True

    def _insert(self, entry: tuple[bytes, object]) -> None:
        while True:
            tag, one, two = self._places(entry[0])
            for bucket in (one, two):
                if self._free(bucket, tag, entry):
                    return
            bucket = two
            for _ in range(MAX_KICKS):
                self.turn = (self.turn + 1) % SLOTS
                at = bucket * SLOTS + self.turn
                moved, moved_tag = self.entries[at], self.tags[at]
                self.entries[at], self.tags[at] = entry, tag
                entry, tag = moved, moved_tag
                bucket = self._other(bucket, tag)
                if self._free(bucket, tag, entry):
                    return
            # overflow: twice the buckets, filled from the stored keys; the entry in hand comes after them
            kept = [x for x in self.entries if x is not None]
            self._clear(2 * (self.mask + 1))
            for x in kept:
                self._insert(x)

    def _free(self, bucket: int, tag: int, entry: tuple[bytes, object]) -> bool:
        at = self.tags.find(0, bucket * SLOTS, bucket * SLOTS + SLOTS)
        if at < 0:
            return False
        self.tags[at], self.entries[at] = tag, entry
        self.n += 1
        return True

    def __len__(self) -> int:
        return self.n

    def __contains__(self, digest: bytes) -> bool:
        return self._find(digest) >= 0

    def items(self) -> Iterable[tuple[bytes, object]]:
        return (x for x in self.entries if x is not None)


def _entry(kind: T.DataType) -> T.StructType:
    """An index entry as a row: digest, and of the row that stays doc_id, place and length; n counts the group's rows."""
    fields = {"digest": T.BinaryType(), "no_id": T.BooleanType(), "keep_id": kind, "keep_file": T.LongType(), "keep_row": T.LongType(), "length": T.LongType(), "n": T.LongType()}
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _entries(index: CuckooIndex, schema: T.StructType) -> pa.RecordBatch:
    rows = [(d, *v) for d, v in index.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(schema)], schema.names)


def _fold(index: CuckooIndex, digest: bytes, row: tuple) -> None:
    """row: (no doc_id, doc_id, file, row, length, rows). The longest text stays, then the least doc_id, then the first place."""
    had = index.get(digest)
    if had is None:
        index.put(digest, row)
    else:
        best = min(had, row, key=lambda x: (-x[4], x[0], 0 if x[0] else x[1], x[2], x[3]))
        index.put(digest, (*best[:5], had[5] + row[5]))


def _code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[offsets[1:]] - heads[offsets[:-1]]


def _digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, file, row, digest, length) of rows(doc_id, file, row, text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(3))
            whole = memoryview(data.tobytes())
            at = offsets.tolist()
            found = [hashlib.sha256(bytes(whole[a:b]).translate(None, BLANKS)).digest() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary()), pa.array(_code_points(data, offsets))], ["doc_id", "file", "row", "digest", "length"])
        release()

    kind = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("file", "row")]
    return docs.mapInArrow(digest, T.StructType([kind, *longs, T.StructField("digest", T.BinaryType()), T.StructField("length", T.LongType())]))


def _digests(docs: DataFrame, place: list[str]) -> DataFrame:
    file, row = place
    return materialize(_digest_rows(docs.select("doc_id", F.col(file).alias("file"), F.col(row).alias("row"), "text")), "digests")


def _groups(rows: DataFrame) -> DataFrame:
    entry = _entry(rows.schema["doc_id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for doc, file, row, digest, length in zip(*(c.to_pylist() for c in batch.columns)):
                _fold(index, digest, (doc is None, doc, file, row, length, 1))
                if len(index) >= SCAN_ENTRIES:
                    yield _entries(index, entry)
                    index = CuckooIndex()
        yield _entries(index, entry)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # entries come sorted by digest prefix, so the index may be emptied between prefixes and stays small
        index, prefix = CuckooIndex(), None
        for batch in batches:
            for digest, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(index) >= SCAN_ENTRIES and digest[:4] != prefix:
                    yield _entries(index, entry)
                    index = CuckooIndex()
                prefix = digest[:4]
                _fold(index, digest, tuple(row))
        yield _entries(index, entry)

    return rows.mapInArrow(scan, entry).repartition("digest").sortWithinPartitions("digest").mapInArrow(merge, entry)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digests(*placed(docs.select("doc_id", "text")))
    # a group may hold a third of the rows: the adaptive skew join splits the rows' side
    found = rows.join(_groups(rows).drop("length"), "digest")
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns) with one row of each group of equal texts."""
    numbered, place = placed(docs)
    rows = _digests(numbered, place)
    copies = rows.select("file", "row", "digest").join(_groups(rows).where("n > 1").select("digest", "keep_file", "keep_row"), "digest")
    gone = copies.where("file <> keep_file OR row <> keep_row").select(F.col("file").alias(place[0]), F.col("row").alias(place[1]))
    return without(numbered, place, materialize(gone, "gone")).select(*docs.columns)


def live_digests(changes: DataFrame) -> DataFrame:
    """State after a log of changes(seq, op, text): op 'insert' or 'delete', applied in seq order per digest.

    Returns (text_sha256, seq) for each digest that is live at the end, seq being its first insertion since it was
    last deleted. Inserting a live digest, and deleting one that isn't live, changes nothing. Equal seq: insertions
    come first. The log of one digest is a stream in seq order, of which only the index entry is held.
    """
    digest = F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256))
    log = changes.select(digest.alias("digest"), F.col("seq").cast("long").alias("seq"), (F.col("op") == "delete").alias("gone"))

    def live(index: CuckooIndex) -> pa.RecordBatch:
        rows = list(index.items())
        return pa.RecordBatch.from_arrays([pa.array([d.hex() for d, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int64())], ["text_sha256", "seq"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = CuckooIndex(), None
        for batch in batches:
            for d, seq, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if len(index) >= SCAN_ENTRIES and d != last:
                    yield live(index)
                    index = CuckooIndex()
                last = d
                if gone:
                    index.delete(d)
                elif d not in index:
                    index.put(d, seq)
        yield live(index)

    ordered = log.repartition("digest").sortWithinPartitions("digest", "seq", "gone")
    return ordered.mapInArrow(apply, "text_sha256 string, seq long")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, text_sha256 FROM g
"""
