"""Document probability under a subword lattice.

The pieces are those of an existing vocabulary, and its scores weight all segmentations of the training words: the expected number of
uses of each piece under them, added to the scores as pseudo-counts, makes the pieces' unigram probabilities. Words are
lower-cased runs of non-blanks with one space in front; pieces hold a space at their head or not at all, so
words segment independently, a distinct word is scored once for the whole corpus, and the marginals of all words sum to one. A word's
probability is the marginal over all its segmentations, by forward recursion in log space. Single bytes are always pieces, so any text has a
probability. ``score`` is the log10 of a document's: after each word the text ends or goes on, at the training rows' rate, so those of all texts
sum to one. ``existing_score`` is the same under the vocabulary's scores alone, without anything learned but that rate.

``mixed_score`` mixes in whole words: a word that training has seen is a piece as well, with its count less an absolute discount as weight;
the discounts' sum is the weight of all other segmentations, half of it for those that begin with a seen word and end in punctuation.
``base_score`` is the add-0.1 word unigram. Both need each word's corpus count. Words are counted per task, then across tasks, and told apart by their
bytes; the FREQUENT most frequent ones are broadcast (a fixed bound), and the tokens
that remain meet their counts in a join. No table as large as the corpus's vocabulary is ever in one place.

A null text is empty and holds the end token only. Repeated rows are scored alike, each by itself. Without training
words the pieces keep the vocabulary's weights, and a word and the end are each as likely as not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, materialize, placed
from .text import BLANK, coded, pieces, span_values, spans, string_bytes

FREQUENT = 1 << 18
PART_BYTES = 2 << 20
#: Distinct words a task gathers before it hands them on; bytes of words in one lattice; longest word that is walked among others.
GATHER = 1_200_000
LATTICE_BYTES = 1 << 20
LONG_WORD = 256
#: Uses of pieces that the vocabulary's scores count for, in all.
PRIOR_PIECES = 10_000.0
#: Candidates for the absolute discount; of what it frees, the share of known words with other punctuation behind them.
DISCOUNTS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
CORE_SHARE = 0.5
#: What is summed over a text's words.
SCORES = ["base", "lattice", "plain", "model"]
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Surfaces and starting log probabilities of a sentencepiece vocabulary, bytes added where missing.

    The scores of a BPE vocabulary are minus the merge rank, so weights fall off with rank; scores of a unigram
    vocabulary are log probabilities and are used as such.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranked = min(scores) < -1000
    for i, score in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        surface = model.id_to_piece(i).replace("▁", " ").encode()
        if surface.rfind(b" ") > 0 or surface.lower() != surface:
            continue
        w = 1.0 / (10.0 - score) if ranked else math.exp(score)
        weight[surface] = weight.get(surface, 0.0) + w
    least = min(weight.values(), default=1.0) / 10
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    surfaces = sorted(weight)
    w = np.array([weight[s] for s in surfaces])
    return surfaces, np.log(w / w.sum())


class Lattice:
    """A trie of the pieces, walked for many words at once."""

    def __init__(self, surfaces: list[bytes], logp: np.ndarray):
        self.surfaces, self.logp = surfaces, logp
        self.longest = max(map(len, surfaces))
        nodes: dict[bytes, int] = {b"": 0}
        for s in surfaces:
            for k in range(1, len(s) + 1):
                nodes.setdefault(s[:k], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        for i, s in enumerate(surfaces):
            self.piece[nodes[s]] = i
        keys = np.array([nodes[p[:-1]] << 8 | p[-1] for p in nodes if p], np.int64)
        child = np.array([n for p, n in nodes.items() if p], np.int32)
        size = 1 << (4 * len(keys) - 1).bit_length()
        self.mask, self.shift = size - 1, np.uint64(64 - (size.bit_length() - 1))
        self.slot_key, self.slot_child = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.probes = 0
        for key, c, at in zip(keys.tolist(), child.tolist(), self._slot(keys).tolist()):
            n = 0
            while self.slot_key[(at + n) & self.mask] >= 0:
                n += 1
            self.slot_key[(at + n) & self.mask], self.slot_child[(at + n) & self.mask] = key, c
            self.probes = max(self.probes, n + 1)
        self.step_of = {k: c for k, c in zip(keys.tolist(), child.tolist())}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        at = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for n in range(self.probes):
            here = (at[left] + n) & self.mask
            found = self.slot_key[here]
            hit = found == key[left]
            out[left[hit]] = self.slot_child[here[hit]]
            left = left[~hit & (found >= 0)]
            if not len(left):
                break
        return out

    def arcs(self, data: np.ndarray, stop: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: (start positions, pieces) of the pieces that lie within a word. stop: of its word."""
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        out = []
        for n in range(self.longest):
            inside = at + n < stop[at]
            at, node = at[inside], node[inside]
            node = self._step(node, data[at + n])
            some = node >= 0
            at, node = at[some], node[some]
            p = self.piece[node]
            whole = p >= 0
            out.append((at[whole], p[whole]))
            if not len(at):
                break
        return out

    def run(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(natural log marginal of each word, expected piece counts if ``counts`` is given)."""
        result = np.zeros(len(words))
        expected = np.zeros(len(self.surfaces)) if counts is not None else None
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        long = order[size[order] > LONG_WORD]
        for k in long.tolist():
            result[k] = self._single(words[k], expected, float(counts[k]) if counts is not None else 0.0)
        order = order[len(long) :]
        total = np.cumsum(size[order] + 1)
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LATTICE_BYTES)))
            part = order[lo:hi]
            result[part] = self._many([words[k] for k in part.tolist()], size[part], expected, counts[part] if counts is not None else None)
            lo = hi
        return result, expected

    def _many(self, words: list[bytes], size: np.ndarray, expected: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        """Words by falling length, one byte of slack after each: a word's nodes are its bytes and that slack."""
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        base = np.cumsum(size + 1) - (size + 1)
        stop = np.repeat(base + size, size + 1)
        arcs = self.arcs(data, stop)
        weight = np.full((len(arcs), len(data)), -np.inf)
        for n, (at, p) in enumerate(arcs):
            weight[n, at] = self.logp[p]
        alpha = np.full(len(data), -np.inf)
        alpha[base] = 0.0
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
        for t, n in enumerate(live, 1):
            here = base[:n] + t
            back = np.arange(1, min(t, len(arcs)) + 1)[:, None]
            alpha[here] = _logsum(alpha[here - back] + weight[back - 1, here - back])
        marginal = alpha[base + size]
        if expected is not None:
            beta = np.full(len(data), -np.inf)
            beta[base + size] = 0.0
            last = base + size
            for t, n in enumerate(live, 1):
                here = last[:n] - t
                step = np.arange(1, min(t, len(arcs)) + 1)[:, None]
                beta[here] = _logsum(beta[here + step] + weight[step - 1, here])
            z = np.repeat(marginal, size + 1)
            c = np.repeat(counts.astype(float), size + 1)
            for n, (at, p) in enumerate(arcs, 1):
                share = np.exp(alpha[at] + self.logp[p] + beta[at + n] - z[at]) * c[at]
                expected += np.bincount(p, share, len(expected))
        return marginal

    def _single(self, word: bytes, expected: np.ndarray | None, count: float) -> float:
        n, arcs = len(word), []
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            node = 0
            for j in range(i, n):
                node = self.step_of.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                p = int(self.piece[node])
                if p >= 0:
                    x, y = alpha[j + 1], alpha[i] + self.logp[p]
                    alpha[j + 1] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
                    if expected is not None:
                        arcs.append((i, j + 1, p))
        if expected is not None:
            beta = [-math.inf] * n + [0.0]
            for i, j, p in reversed(arcs):
                x, y = beta[i], beta[j] + self.logp[p]
                beta[i] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
            for i, j, p in arcs:
                expected[p] += count * math.exp(alpha[i] + self.logp[p] + beta[j] - alpha[n])
        return alpha[n]


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def _words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, pa.Array, np.ndarray]]:
    """By pieces: (first document, end, first word of each document and the end, distinct words, number of each word among them)."""
    for lo, hi in pieces(offsets, PART_BYTES):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, at, ~BLANK)
        yield lo, hi, first, *coded(span_values(part, starts, ends))


def word_counts(docs: DataFrame) -> DataFrame:
    """Distinct words of rows(learn, tune, text): word (lower-cased), c (occurrences in
    rows to learn from) and dev (those of them that are also rows to tune on)."""

    def merged(parts: list[tuple]) -> tuple:
        words, which = coded(pa.concat_arrays([p[0] for p in parts]))
        return words, *(np.bincount(which, np.concatenate([p[k] for p in parts]), len(words)).astype(np.int64) for k in (1, 2))

    def batch_of(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part[0].cast(pa.binary()), pa.array(part[1]), pa.array(part[2])], ["word", "c", "dev"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            learn, tune = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for lo, hi, first, words, which in _words(*string_bytes(batch.column(2))):
                held.append((words, *(np.bincount(which, np.repeat(x[lo:hi], np.diff(first)), len(words)).astype(np.int64) for x in (learn, tune))))
                if sum(len(x[0]) for x in held) > GATHER:
                    held = [merged(held)]
                    if len(held[0][0]) > GATHER // 2:
                        yield batch_of(held.pop())
        if held:
            yield batch_of(merged(held))

    each = docs.select("learn", (F.col("learn") & F.col("tune")).alias("tune"), "text").mapInArrow(count, "word binary, c long, dev long")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("dev").alias("dev"))


def _spaced(words: pa.Array) -> list[bytes]:
    return [b" " + w for w in words.to_pylist()]


def learn_pieces(words: DataFrame, surfaces: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces: their expected uses in ``words(word, c)``, each word c times, under ``logp``, which counts for PRIOR_PIECES uses.

    One sum per piece reaches the driver, i.e. as many rows as the vocabulary has.
    """
    shared = words.sparkSession.sparkContext.broadcast(Lattice(surfaces, logp))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = shared.value, np.zeros(len(surfaces))
        for batch in batches:
            sums += lattice.run(_spaced(batch.column(0)), batch.column(1).to_numpy())[1]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["piece", "n"])

    weight = PRIOR_PIECES * np.exp(logp)
    for r in words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        weight[r.piece] += r.n
    return np.log(weight / weight.sum())


def _add(x: Column, y: Column) -> Column:
    """log10(10**x + 10**y)"""
    return F.greatest(x, y) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(x - y)))


def _model(c: Column, core: Column, tokens: int, seen: int, discount: float) -> Column:
    """log10 probability of a word from its count, its core's count, and the columns q and tail."""
    rest = math.log10(discount * seen / tokens if seen else 0.5)
    pieces_only = F.col("q") + math.log10(1 - CORE_SHARE)
    with_core = F.col("tail") + F.log10(CORE_SHARE * core / max(tokens, 1))
    other = rest + F.when(core > 0, _add(with_core, pieces_only)).otherwise(F.when(F.col("core").isNull(), F.col("q")).otherwise(pieces_only))
    return F.when(c > 0, _add(F.log10((c - discount) / max(tokens, 1)), other)).otherwise(other)


def score(docs: DataFrame, path: str, train: str, tune: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, existing_score, mixed_score.

    ``train``: name of a boolean column; the model learns from the rows where it holds. The discount is the one of
    DISCOUNTS under which the rest of them best explains those where ``tune`` holds.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(train).alias("learn"), F.col(tune).alias("tune"), "text")
    words = materialize(word_counts(docs), "words")
    ends = {r.tune: r["count"] for r in docs.where("learn").groupBy("tune").count().collect()}
    n_train, n_tune = sum(ends.values()), ends.get(True, 0)
    sums = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("dev"), F.count(F.when(F.col("c") > F.col("dev"), 1))).first()
    tokens, seen = (sums[0] or 0) + n_train, sums[1]
    distinct = seen + (n_train > 0)
    surfaces, existing = vocabulary_pieces(path)
    logp = learn_pieces(words, surfaces, existing)
    shared = spark.sparkContext.broadcast((Lattice(surfaces, existing), Lattice(surfaces, logp)))
    to_space = math.log10(sum(math.exp(p) for s, p in zip(surfaces, logp.tolist()) if s[:1] == b" "))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, learned = shared.value
        for batch in batches:
            own = _spaced(batch.column(0))
            stems = [w.rstrip(PUNCTUATION) for w in own]
            some = np.array([1 < len(s) < len(w) for s, w in zip(stems, own)], bool)
            at = np.flatnonzero(some).tolist()
            tails, which = np.unique(np.array([own[k][len(stems[k]) :] for k in at], object), return_inverse=True) if at else (np.zeros(0, object), np.zeros(0, int))
            tail = np.zeros(len(own))
            tail[some] = (learned.run(tails.tolist())[0] / math.log(10) + to_space)[which]
            core = pa.array([s[1:] if k else None for s, k in zip(stems, some.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.run(own)[0] / math.log(10)) for x in (plain, learned)), core, pa.array(tail)], ["word", "c", "dev", "p", "q", "core", "tail"])

    parts = words.select("word", "c", "dev").mapInArrow(marginal, "word binary, c long, dev long, p double, q double, core binary, tail double")
    cores = words.where("c > 0").select(F.col("word").alias("core"), F.col("c").alias("core_c"), F.col("dev").alias("core_dev"))
    # words without a core don't take part in the join, so no key is hot: a core has as many words as it has tails
    with_core = parts.where("core IS NOT NULL").join(cores, "core", "left")
    parts = parts.where("core IS NULL").withColumns({"core_c": F.lit(None).cast("long"), "core_dev": F.lit(None).cast("long")}).unionByName(with_core)
    parts = materialize(parts.fillna(0, ["core_c", "core_dev"]), "parts")

    discount = DISCOUNTS[len(DISCOUNTS) // 2]
    if sums[2]:
        left = tokens - sums[2] - n_tune
        trial = [F.sum(F.col("dev") * _model(F.col("c") - F.col("dev"), F.col("core_c") - F.col("core_dev"), left, sums[3], d)) for d in DISCOUNTS]
        found = parts.where("dev > 0").agg(*trial).first()
        discount = max(zip(found, DISCOUNTS))[1] if sums[3] else discount
    scale = math.log10(tokens + 0.1 * (distinct + 1))
    end_p = n_train / tokens if seen else 0.5
    go_on, stop = math.log10(1 - end_p) if end_p < 1 else 0.0, math.log10(end_p) if end_p else 0.0
    base = F.log10(F.col("c") + 0.1) - F.lit(scale)
    scored = parts.select("word", "c", base.alias("base"), (F.col("q") + go_on).alias("lattice"), (F.col("p") + go_on).alias("plain"), _model(F.col("c"), F.col("core_c"), tokens, seen, discount).alias("model"))
    scored = materialize(scored, "scored")

    # the frequent words: all counts above a limit that at most ``frequent`` words exceed
    level = F.floor(F.log2("c") * 8)
    heights, above, least = scored.where("c > 1").groupBy(level.alias("k")).count().collect(), 0, None
    for r in sorted(heights, key=lambda r: -r[0]):
        above += r["count"]
        if above > frequent:
            break
        least = r[0]
    top = scored.where("c > 1").where(level >= least) if least is not None else scored.where("false")
    rows = top.select("word", *SCORES).toArrow()
    known = spark.sparkContext.broadcast((rows.column(0).combine_chunks().cast(pa.large_binary()), np.column_stack([rows.column(n).to_numpy() for n in SCORES])))
    ends = (math.log10(n_train + 0.1) - scale, stop, stop, stop)
    end_known = int(n_train > 0)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = known.value
        for batch in batches:
            for lo, hi, first, words, which in _words(*string_bytes(batch.column(4))):
                found = pc.index_in(words, keys).fill_null(-1).to_numpy(zero_copy_only=False)[which]
                hit = found >= 0
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                sums = [pa.array(np.bincount(doc[hit], values[found[hit], k], hi - lo) + end) for k, end in enumerate(ends)]
                rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=hi - lo))])
                tails = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), words.take(pa.array(which[~hit])).cast(pa.binary()))
                n_known = np.bincount(doc[hit], minlength=hi - lo) + end_known
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:4]), pa.array(np.diff(first) + 1), pa.array(n_known), *sums, tails], names=schema.names)

    slim, place = placed(docs)
    file, row = place
    slim = slim.select(F.col(file).alias("file"), F.col(row).alias("row"), "doc_id", "learn", "text")
    more = {"n": T.LongType(), "k": T.LongType(), **dict.fromkeys(SCORES, T.DoubleType()), "tails": T.ArrayType(T.BinaryType())}
    schema = T.StructType([*slim.schema[:4], *(T.StructField(n, t) for n, t in more.items())])
    partial = materialize(slim.mapInArrow(near, schema), "partial")
    rare = scored.where("c <= 1" if least is None else (F.col("c") <= 1) | (level < least))
    far = partial.select("file", "row", F.explode("tails").alias("word")).join(rare, "word").groupBy("file", "row")
    far = far.agg(*(F.sum(n).alias(f"far_{n}") for n in SCORES), F.sum((F.col("c") > 0).cast("long")).alias("far_k"))
    whole = lambda n: F.col(n) + F.coalesce(f"far_{n}", F.lit(0))
    return partial.join(far, ["file", "row"], "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), F.col("n").alias("n_tokens"), whole("k").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"), whole("lattice").alias("score"), whole("plain").alias("existing_score"), whole("model").alias("mixed_score"),
    )


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    ten = fold(F.col("doc_id"), 10)
    return score(docs.select("doc_id", "text", (ten != 0).alias("train"), (ten == 1).alias("tune")), path, "train", "tune")
