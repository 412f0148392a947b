"""SimHash near-duplicate documents: at three differing bits of 64, and at similarity 0.8 by a wide fingerprint and a check of the shingles.

Fingerprints are made in one pass over the texts; rows with equal fingerprints become one class before
anything is joined, classes meet on pigeonhole blocks (see ``linking``), and Hamming distance is verified.
A crowded bucket is linked without all its pairs, and no link is lost.

A null text has no words. A text without words has fingerprint zero and is linked like any other. Repeated rows
and rows without doc_id share their fingerprint's component; a component's id is its least doc_id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, key_prefilter, materialize, placed, without
from .linking import block_keys, near_components, within
from .text import BLANK, LOWER, pieces, release, spans, string_bytes

#: Words in a shingle for near-duplicate work where nothing else is asked for.
SHINGLE = 5
#: Differing bits of 64 within which fingerprints link.
MAX_BITS = 3
PIECE_BYTES = 4 << 20
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16

#: The fingerprint for similarity 0.8: 64-bit words, blocks, shingles sampled for a block, and the differing bits allowed.
#: Jaccard 0.8 is a cosine of 0.889, at which 15.1 % of the bits differ; one standard deviation at 512 bits is 1.6 %.
WIDE = 8
WORDS = [f"f{k}" for k in range(WIDE)]
BLOCKS, SAMPLE = 24, 7
WIDE_BITS = 84
#: Candidates are verified by their shingles. They may differ by three standard deviations more, and by no more than LIMIT in a weighted sum of
#: differing bits and of sampled least hashes whose last four bits differ (expected at 0.8: 77 and 31.5). The weights tell 0.8 and 0.7 apart best;
#: the limit is three standard deviations above 0.8.
LOOSE_BITS = WIDE_BITS + 24
BIT_WEIGHT, HASH_WEIGHT, LIMIT = 29, 54, 5050
#: Longs of sixteen last four bits each.
TAILS = [f"t{k}" for k in range(-(-24 * 7 // 16))]
#: Longs with a bit per class of shingles, set if the text has an odd number of them. Two texts differ in at least as many shingles as in such bits,
#: which excludes pairs without losing any.
PARITIES = [f"p{k}" for k in range(16)]
SIMILARITY = 0.8


def fingerprint(data: np.ndarray, words: int) -> int:
    """SimHash of one text's bytes: a bit is set if it is set in over half of the shingles' hashes."""
    return int(_fingerprints(data, np.array([0, len(data)]), words)[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNT_ROWS):
        part = np.ascontiguousarray(hashes[k : k + COUNT_ROWS]).view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, XXH64 of its shingles, repeats included) for the documents with words."""
    starts, ends, first = spans(data, offsets, ~BLANK)
    # the words joined by one space each, so that a shingle is one slice
    length = ends - starts
    at = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int((length + 1).sum()), 32, np.uint8)
    if len(starts):
        heads = np.cumsum(length) - length
        step = np.ones(int(length.sum()), np.int64)
        step[heads] = starts - np.concatenate([[0], ends[:-1] - 1])
        source = np.cumsum(step)
        step[:] = 1
        step[heads] = at - np.concatenate([[0], (at + length)[:-1] - 1])
        joined[np.cumsum(step)] = LOWER[data[source]]
    text, stops = memoryview(joined.tobytes()), at + length
    digest = xxhash.xxh64_intdigest
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a < b:
            n = max(1, b - a - words + 1)
            lo, hi = at[a : a + n].tolist(), stops[min(a + words, b) - 1 : b].tolist()
            yield d, np.fromiter((digest(text[s:e], 42) for s, e in zip(lo, hi)), np.uint64, n)


def _fingerprints(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.uint64)
    for d, hashes in _shingle_hashes(data, offsets, words):
        out[d] = _WEIGHTS[2 * _bit_counts(hashes) > len(hashes)].sum(dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, name: str, words: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, and with the fingerprint as a long."""
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, T.LongType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(len(rest)))
            parts = [_fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words) for a, b in pieces(offsets, PIECE_BYTES)]
            found = np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(found)], names=[*rest, name])

    return docs.select(*rest, "text").mapInArrow(make, schema)


def classes(prints: DataFrame) -> DataFrame:
    """Of rows (doc_id, fp): each fingerprint with its component's least doc_id: (fp, component_id)."""
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # xxhash64 is a bijection of a long under one seed, so ids stay unique and are in random order
    items = each.select(F.xxhash64("fp").alias("id"), "fp")
    roots = near_components(block_keys(items, MAX_BITS), within(MAX_BITS), label="simhash")
    placed = each.withColumn("id", F.xxhash64("fp")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = placed.where(F.col("root") != F.col("id")).groupBy("root").agg(F.min("least").alias("other"))
    # only linked fingerprints need the second join; hubs are combined before the shuffle
    own = placed.join(least, "root", "left").where("root = id").select("root", F.least("least", "other").alias("component_id"))
    return placed.select("fp", "root").join(own, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(with_fingerprint(docs.select("doc_id", "text"), "fp", words), "fingerprints")
    # rows that share a fingerprint may be a third of all: the adaptive skew join splits their side
    found = prints.join(classes(prints), "fp", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """hashes x seeds: further hashes of the same shingles."""
    x = hashes[:, None] * seeds[None, :]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_SEEDS = np.random.default_rng(77).integers(1, 2**63, WIDE + BLOCKS * SAMPLE, dtype=np.uint64) | np.uint64(1)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Which classes of hashes hold an odd number of them, as bits of longs."""
    classes = 64 * len(PARITIES)
    odd = np.bincount((hashes % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _wide(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the WIDE fingerprint words, the block keys, the last four bits of the sampled hashes) of a text's distinct shingle hashes."""
    counts, least = np.zeros((WIDE, 64), np.int64), np.full(BLOCKS * SAMPLE, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        more = _mixed(hashes[k : k + 4096], _SEEDS)
        bits = np.unpackbits(np.ascontiguousarray(more[:, :WIDE]).view(np.uint8).reshape(len(more), WIDE, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        np.minimum(least, more[:, WIDE:].min(axis=0), out=least)
    words = (_WEIGHTS[None, :] * (2 * counts > len(hashes))).sum(axis=1, dtype=np.uint64)
    # a block's fingerprint is the SimHash of its sampled shingles
    bits = np.unpackbits(least.view(np.uint8).reshape(BLOCKS, SAMPLE, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    blocks = (_WEIGHTS[None, :] * (2 * bits > SAMPLE)).sum(axis=1, dtype=np.uint64)
    tails = np.zeros(16 * len(TAILS), np.uint64)
    tails[: len(least)] = least & np.uint64(15)
    return words, blocks ^ _SEEDS[:BLOCKS], (tails.reshape(-1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def wide_fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(file, row, doc_id, f0 ... f7, t0 ... t10, p0 ... p15, n, blocks) of rows(file, row, doc_id, text); n: distinct shingles; no blocks for a text without words."""
    names = [*WORDS, *TAILS, *PARITIES, "n"]
    tails, n_at = WIDE + len(TAILS), len(names) - 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(3))
            for lo, hi in pieces(offsets, PIECE_BYTES):
                n = hi - lo
                prints, keys = np.zeros((n, len(names)), np.uint64), [np.zeros(0, np.uint64)] * n
                for d, hashes in _shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words):
                    hashes = np.unique(hashes)
                    prints[d, :WIDE], keys[d], prints[d, WIDE:tails] = _wide(hashes)
                    prints[d, tails:n_at], prints[d, n_at] = _parities(hashes), len(hashes)
                ends = np.cumsum([0, *map(len, keys)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                longs = [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[:3]), *longs, listed], names=["file", "row", "doc_id", *names, "blocks"])
        release()

    longs = [T.StructField(n, T.LongType()) for n in ("file", "row", *names)]
    schema = T.StructType([*longs[:2], T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs[2:], T.StructField("blocks", T.ArrayType(T.LongType()))])
    return docs.select("file", "row", "doc_id", "text").mapInArrow(make, schema)


def _differing_shingles(a, b):
    """No more than the shingles that one of two texts has and the other lacks."""
    odd = sum((F.bit_count(a(p).bitwiseXOR(b(p))) for p in PARITIES), F.lit(0))
    return F.greatest(odd.cast("long"), F.abs(a("n") - b("n")))


def _near_words(a, b, least: float = SIMILARITY):
    bits = sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in WORDS), F.lit(0))

    def differing(name: str):
        """How many of sixteen groups of four bits differ."""
        x = a(name).bitwiseXOR(b(name))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    tails = sum((differing(t) for t in TAILS), F.lit(0))
    # of sets of n and m at a similarity of s, (n + m) (1 - s) / (1 + s) shingles differ
    may = (1 + least) * _differing_shingles(a, b) <= (1 - least) * (a("n") + b("n")) + 1e-6
    return may & (bits <= LOOSE_BITS) & (BIT_WEIGHT * bits + HASH_WEIGHT * tails <= LIMIT)


def shingle_sets(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(id, shingles) of rows(id, text): the distinct shingle hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for lo, hi in pieces(offsets, PIECE_BYTES):
                sets = [np.zeros(0, np.uint64)] * (hi - lo)
                for d, hashes in _shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words):
                    sets[d] = np.unique(hashes)
                ends = np.cumsum([0, *map(len, sets)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), listed], names=["id", "shingles"])
        release()

    return docs.select("id", "text").mapInArrow(make, "id long, shingles array<long>")


def similar_components(prints: DataFrame, texts: DataFrame, words: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(id, root) of the rows of ``wide_fingerprints`` with their ids that have a near duplicate.

    Keys travel alone; the fingerprints join the candidates, and of those within LOOSE_BITS the shingles of ``texts`` (file, row, text) are compared.
    """
    keyed = prints.select("id", F.explode(F.array_distinct("blocks")).alias("key"))

    def verify(pairs: DataFrame, later: DataFrame | None) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        at = materialize(key_prefilter(prints.select("id", "file", "row"), "id", ids).join(ids, "id", "left_semi"), "similar-places")
        named = key_prefilter(texts, ["file", "row"], at).join(at, ["file", "row"]).select("id", "text")
        sets = materialize(shingle_sets(named, words), "similar-sets")
        both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
        shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
        return both.where((1 + least) * shared + 1e-9 >= least * total).select("a", "b")

    # a pair is made under the least of the blocks that it shares
    once = lambda a, b: F.col("key") == F.array_min(F.array_intersect(a("blocks"), b("blocks")))
    near = lambda a, b: _near_words(a, b, least)
    return near_components(keyed, near, verify, items=prints.select("id", *WORDS, *TAILS, *PARITIES, "n", "blocks"), label="similar", once=once)


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` (any columns) with one row of each group of similar texts: the one with the least doc_id, nulls last.

    Similar: sets of ``words``-word shingles with a Jaccard similarity of 0.8 or more, counted on their 64-bit hashes. Candidates share a block
    and differ in at most LOOSE_BITS of a 512-bit SimHash, so a pair just above 0.8 may rarely be missed, and none below it is joined.
    At that similarity 64-bit fingerprints differ in some ten bits, which no exact split into blocks reaches; here a
    block is the SimHash of seven sampled shingles, the same ones in both texts if their
    samples agree, which at a similarity of 0.8 is so in a fifth of the blocks. Texts without words are all kept. Repeated rows are
    told apart by their place in the files.
    """
    numbered, place = placed(docs)
    rows = numbered.select(F.col(place[0]).alias("file"), F.col(place[1]).alias("row"), "doc_id", "text")
    # the ids are a bijection of a row number, stored with the fingerprints: unique, and in random order
    prints = materialize(wide_fingerprints(rows, words).withColumn("id", F.xxhash64(F.monotonically_increasing_id())), "prints")
    roots = similar_components(prints, rows.drop("doc_id"), words)
    found = prints.select("file", "row", "doc_id", "id").join(roots, "id")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("best"))
    gone = found.join(best, "root").where("file <> best.file OR row <> best.row").select(F.col("file").alias(place[0]), F.col("row").alias(place[1]))
    return without(numbered, place, materialize(gone, "gone")).select(*docs.columns)
