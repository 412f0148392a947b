"""Benchmark decontamination by suffix arrays of the training text.

Every batch of documents becomes a shard: its words turn into ids of the benchmark's vocabulary, the
suffixes that may hold a whole window (their run of vocabulary words is as long as the shortest window; any
other suffix can match none) are sorted into a suffix array, and each window of each test item, i.e. the head of
each test suffix, is binary-searched in it. Matches that continue each other are joined into longest
verbatim matches. Words are known by their bytes.

Nothing is shuffled. The benchmark is cut into blocks of at most BLOCK_BYTES or one item, each
broadcast alone; every shard searches the blocks one after the other, so neither its size nor that of
the documents is bounded. With several blocks a shard is MANY_BYTES of text, so that a block is unpacked less often.

Null or wordless texts have no words and match nothing. Repeated items count once by item_id; items whose
id is null share the id "". Repeated documents are each judged alone. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, coded, gathered, pieces, release, span_values, spans, string_bytes

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bytes of text that are split into words at a time; suffixes that are sorted at a time.
SHARD_BYTES = 2 << 20
MANY_BYTES = 32 << 20
SHARD_SUFFIXES = 1 << 20

#: Letters of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and every byte from 0x80.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = WORD[128:] = True


class Block:
    """A part of the benchmark: vocabulary, and distinct windows with the items that hold them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        data, at = string_bytes(pa.array([t for _, t in items], pa.large_string()))
        starts, ends, first = spans(data, at, WORD)
        low = LOWER[data].tobytes()
        words = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        self.ids = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
        self.names = [name for name, _ in items]
        self.texts = [np.array([self.ids[w] for w in words[a:b]], np.int32) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        where: dict[bytes, list[tuple[int, int]]] = {}
        for k, ids in enumerate(self.texts):
            if len(ids):
                n = min(window, len(ids))
                for i in range(len(ids) - n + 1):
                    where.setdefault(ids[i : i + n].astype(">u4").tobytes(), []).append((k, i))
        keys = sorted(where)
        self.places = [where[k] for k in keys]
        self.sizes = np.array([len(k) // 4 for k in keys], np.int64)
        self.least = int(self.sizes.min()) if keys else 0
        self.low = np.array(keys, f"S{4 * window}")
        self.high = np.array([k + b"\xff" * (4 * window - len(k)) for k in keys], f"S{4 * window}")

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, 0 for words that no item has."""
        return np.array([self.ids.get(w, 0) for w in words], np.int32)

    def search(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every occurrence, by binary search of each window in the shard's suffix array."""
        none = np.zeros(0, np.int64)
        if not self.places or not len(ids):
            return none, none
        zeros = np.append(np.flatnonzero(ids == 0), len(ids))
        here = np.arange(len(ids))
        run = np.minimum(zeros[np.searchsorted(zeros, here)], np.repeat(first[1:], np.diff(first))) - here
        suffixes = np.flatnonzero(run >= self.least)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(suffixes), SHARD_SUFFIXES):
            part = suffixes[k : k + SHARD_SUFFIXES]
            cells = np.zeros((len(part), self.window), ">u4")
            for j in range(self.window):
                inside = run[part] > j
                cells[inside, j] = ids[part[inside] + j]
            keys = np.ascontiguousarray(cells).view(f"S{4 * self.window}").ravel()
            array = np.argsort(keys, kind="stable")  # the suffix array
            keys = keys[array]
            lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
            for w in np.flatnonzero(hi > lo):
                at = part[array[lo[w] : hi[w]]]
                found.append((at, np.full(len(at), w, np.int64)))
        if not found:
            return none, none
        return np.concatenate([a for a, _ in found]), np.concatenate([w for _, w in found])

    def longest(self, at: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, its word, document word, words) of maximal matches: occurrences that follow each other are one."""
        pairs = sorted((k, p - i, i) for p, w in zip(at.tolist(), window.tolist()) for k, i in self.places[w])
        out: list[tuple[int, int, int, int]] = []
        for k, shift, i in pairs:
            n = min(self.window, len(self.texts[k]))
            if out and out[-1][0] == k and out[-1][2] - out[-1][1] == shift and i <= out[-1][1] + out[-1][3] - n + 1:
                k0, i0, p0, _ = out[-1]
                out[-1] = (k0, i0, p0, i - i0 + n)
            else:
                out.append((k, i, i + shift, n))
        return out


def covered(n: int, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + sizes, -1)
    return np.cumsum(step[:-1]) > 0


class Benchmark:
    """The blocks, broadcast one by one; a task holds one at a time when there are several."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        spark = benchmark.sparkSession
        items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
        self.shared, held, size = [], [], 0
        for r in items.distinct().orderBy("name", "text").toLocalIterator(prefetchPartitions=False):
            if held and size + len(r.text.encode()) > block_bytes:
                self.shared.append(spark.sparkContext.broadcast(Block(held, window)))
                held, size = [], 0
            held.append((r.name, r.text))
            size += len(r.text.encode())
        if held:
            self.shared.append(spark.sparkContext.broadcast(Block(held, window)))

    def shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(batches, MANY_BYTES) if len(self.shared) > 1 else batches

    @property
    def shard_bytes(self) -> int:
        return MANY_BYTES if len(self.shared) > 1 else SHARD_BYTES

    def __iter__(self) -> Iterator[Block]:
        for shared in self.shared:
            yield shared.value
            if len(self.shared) > 1 and hasattr(shared, "_value"):
                del shared._value


def _scan(column: pa.Array, blocks: Benchmark):
    """For ranges of documents: (first document, end, words per document, hit words, item names, matches)."""
    data, offsets = string_bytes(column)
    for lo, hi in pieces(offsets, blocks.shard_bytes):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, at, WORD)
        values, codes = coded(span_values(part, starts, ends))
        words = values.to_pylist()
        hit = np.zeros(len(starts), bool)
        names: dict[int, set[str]] = {}
        matches: list[tuple[int, str, int, int, int]] = []
        for block in blocks:
            ids = block.lookup(words)[codes]
            found, window = block.search(ids, first)
            if not len(found):
                continue
            hit |= covered(len(starts), found, block.sizes[window])
            doc = np.searchsorted(first, found, "right") - 1
            order = np.argsort(doc, kind="stable")
            found, window, doc = found[order], window[order], doc[order]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]) if len(doc) else ():
                d = int(doc[a])
                names.setdefault(d, set()).update(block.names[k] for w in set(window[a:b].tolist()) for k, _ in block.places[w])
                matches += [(d + lo, block.names[k], i, p - int(first[d]), n) for k, i, p, n in block.longest(found[a:b], window[a:b])]
        n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0)
        yield lo, hi, np.diff(first), n_hit, names, matches


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated, longest and longest_at.

    ``longest``: words of the longest verbatim match with an item (0: none). ``longest_at``: the word, from 0, at which the first one of that length begins (-1: none).
    """
    blocks = Benchmark(benchmark, window, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.shards(batches):
            ids = batch.column(0)
            for lo, hi, n_words, n_hit, names, matches in _scan(batch.column(1), blocks):
                items = [sorted(names.get(d, ())) for d in range(hi - lo)]
                best: dict[int, tuple[int, int]] = {}
                for d, _, _, at, n in matches:
                    best[d - lo] = max(best.get(d - lo, (0, 0)), (n, -at))
                longest, places = np.zeros(hi - lo, np.int64), np.full(hi - lo, -1, np.int64)
                for d, (n, at) in best.items():
                    longest[d], places[d] = n, -at
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(n_hit > 0), pa.array(longest), pa.array(places)],
                    ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated", "longest", "longest_at"],
                )

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, item_ids array<string>, contaminated boolean, longest long, longest_at long"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every longest verbatim match of a window or more: doc_id, item_id, item_word, doc_word, n_words (words from 0)."""
    blocks = Benchmark(benchmark, window)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.shards(batches):
            for *_, matches in _scan(batch.column(1), blocks):
                if matches:
                    at = pa.array([m[0] for m in matches], pa.int64())
                    rest = [pa.array([m[k] for m in matches], pa.string() if k == 1 else pa.int64()) for k in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rest], ["doc_id", "item_id", "item_word", "doc_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id string, item_word long, doc_word long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (any columns) without the rows that hold a window of the benchmark."""
    blocks = Benchmark(benchmark, window)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        found = np.concatenate([n_hit == 0 for _, _, _, n_hit, _, _ in _scan(text, blocks)] or [np.zeros(0, bool)])
        release()
        return pa.array(found)

    return docs.where(clean("text"))


def digests(rows: DataFrame) -> DataFrame:
    """The query's columns from those of ``contamination``."""
    names = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", names, "contaminated", "longest", "longest_at")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item, row_number() OVER () AS k,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, coalesce(text, '') AS text FROM benchmark)),
win AS (
  SELECT item, k, p AS q, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, k, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
cand AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM pos, sizes WHERE p + n - 1 <= len(w)),
hit AS (SELECT r, p, q, k, cand.n, item FROM cand JOIN win ON cand.s = win.s AND cand.n = win.n),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r),
steps AS (SELECT r, k, n, p, p - q AS shift, p - row_number() OVER (PARTITION BY r, k, p - q ORDER BY p) AS island FROM hit),
runs AS (SELECT r, min(p) - 1 AS spot, count(*) + min(n) - 1 AS size FROM steps GROUP BY r, k, shift, island),
best AS (SELECT r, max(size) AS longest, arg_max(spot, size * 1000000000 - spot) AS longest_at FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""
