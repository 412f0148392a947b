"""Multilingual mixture inference.

Each language has a distribution over hashed byte trigrams inside words (lower-cased ASCII; a word's ends count as
blanks), from all training rows. A document is a mixture: every word comes from one language, and
expectation-maximisation estimates the proportions. The set of languages is selected by penalised likelihood:
starting from all, the least one goes as long as half a log of the word count outweighs the likelihood lost.
The prediction is the largest proportion of the selected set, and the score is that proportion.

Training counts are summed per task before the shuffle. The model is a float per language and bucket of trigrams, of MODEL_CELLS in all:
MODEL_BUCKETS buckets up to 256 languages, half as many for twice as many languages, and so on to LEAST_BUCKETS, so what is broadcast has a fixed
bound up to 65,536 languages. Scoring is one pass without a shuffle, over as many words at a time as languages leave room for.

``und`` with score 0: a null text, a text without a letter, or any text when nothing was learned. Rows are judged
alone, repeated or not. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh
from .text import LOWER, coded, pieces, release, span_values, spans, string_bytes

MODEL_BUCKETS, LEAST_BUCKETS = 1 << 16, 1 << 8
MODEL_CELLS = 1 << 24
SMOOTHING = 0.5
ROUNDS = 8
PIECE_BYTES = 2 << 20
#: Words times languages whose likelihoods are computed at a time.
PIECE_CELLS = 2 << 20
#: Languages whose counts a task holds before it hands them on.
HELD = 64
#: A document above this many bytes is judged by its distinct words and their counts.
LARGE = 8 << 20

#: Bytes of words: letters and all of non-ASCII; as trigram symbols everything else is 0.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SYMBOL = np.where(LETTER, LOWER, 0).astype(np.uint32)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashed trigram around every byte; documents don't touch."""
    x = SYMBOL[data]
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(x))]
    left[cuts], right[cuts - 1] = 0, 0
    return (((left << 16) | (x << 8) | right) * np.uint32(0x9E3779B1)) >> np.uint32(16)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: buckets x languages."""
        self.languages = languages
        total = counts.sum(axis=0)
        self.fold = np.uint32(int(MODEL_BUCKETS // len(counts)).bit_length() - 1)
        self.logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * len(counts))).astype(np.float32)
        self.piece_bytes = max(1 << 12, PIECE_BYTES * 8 // max(8, len(languages)))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihoods, counts, first row of each document) of the words, a chunk at a time."""
        starts, ends, first = spans(data, offsets, LETTER)
        one = len(offsets) == 2 and len(data) > LARGE
        held, keys, step = [], [], max(1, PIECE_CELLS // max(4, len(self.languages)))
        for a in range(0, len(starts), step):
            s, e = starts[a : a + step], ends[a : a + step]
            lo, hi = int(s[0]), int(e[-1])
            grams = trigrams(data[lo:hi], np.concatenate([[0], offsets[(offsets > lo) & (offsets < hi)] - lo, [hi - lo]]))
            values = np.add.reduceat(np.where(LETTER[data[lo:hi], None], self.logp[grams >> self.fold], 0), s - lo, axis=0)
            if one:
                distinct, codes = coded(span_values(data[lo:hi], s - lo, e - lo))
                keys.append((distinct, np.bincount(codes, minlength=len(distinct))))
                values = values[np.unique(codes, return_index=True)[1]]
            held.append(values)
        ll = np.concatenate(held or [np.zeros((0, len(self.languages)), np.float32)])
        if not one:
            return ll, np.ones(len(ll), np.float32), first
        if not keys:
            return ll, np.ones(0, np.float32), np.array([0, 0])
        _, which = coded(pa.concat_arrays([k for k, _ in keys]))
        at = np.unique(which, return_index=True)[1]
        return ll[at], np.bincount(which, np.concatenate([n for _, n in keys])).astype(np.float32), np.array([0, len(at)])

    def infer(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions, documents x languages; zero rows for documents without words."""
        ll, weight, first = self.words(data, offsets)
        n_docs, n_lang = len(offsets) - 1, len(self.languages)
        out = np.zeros((n_docs, n_lang), np.float32)
        docs = np.flatnonzero(np.diff(first))
        if not len(docs):
            return out
        peak = ll.max(axis=1, keepdims=True)
        like = np.exp(ll - peak)
        size = np.diff(first)[docs]
        begin = np.cumsum(size) - size
        n = np.add.reduceat(weight, begin)

        def steps(like, weight, begin, size, n, mix, rounds):
            for _ in range(rounds):
                share = like * np.repeat(mix, size, axis=0)
                share *= (weight / np.maximum(share.sum(axis=1), 1e-30))[:, None]
                mix = np.add.reduceat(share, begin, axis=0) / n[:, None]
            total = (like * np.repeat(mix, size, axis=0)).sum(axis=1)
            return mix, np.add.reduceat(weight * np.log(np.maximum(total, 1e-30)), begin)

        mix = np.full((len(docs), n_lang), 1 / n_lang, np.float32)
        mix, best = steps(like, weight, begin, size, n, mix, ROUNDS)
        penalty = 0.5 * np.log(n + 1)
        active = np.ones(len(docs), bool)
        while active.any():
            active &= (mix > 0).sum(axis=1) > 1
            k = np.flatnonzero(active)
            if not len(k):
                break
            trial = mix[k]
            # languages that hold less than half a word go together; else the least one goes
            drop = (trial > 0) & (trial * n[k, None] < 0.5)
            least = np.where(trial > 0, trial, np.inf).argmin(axis=1)
            drop[np.arange(len(k)), least] = True
            drop[np.arange(len(k)), trial.argmax(axis=1)] = False
            trial[drop] = 0
            trial /= trial.sum(axis=1, keepdims=True)
            rows = np.repeat(active, size)
            begun = np.cumsum(size[k]) - size[k]
            trial, value = steps(like[rows], weight[rows], begun, size[k], n[k], trial, 3)
            better = value + penalty[k] * drop.sum(axis=1) >= best[k]
            won = k[better]
            mix[won], best[won] = trial[better], value[better]
            active[k[~better]] = False
        out[docs] = mix
        return out


def learn(docs: DataFrame) -> Model:
    """The model of rows(lang, text); null languages and texts without words teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = string_bytes(batch.column(1))
            for lo, hi in pieces(offsets, PIECE_BYTES):
                names = np.array(langs[lo:hi], object)
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                grams = trigrams(part, at)
                inside = LETTER[part]
                for name in set(names):
                    mine = inside & np.repeat(names == name, np.diff(at))
                    sums.setdefault(name, np.zeros(MODEL_BUCKETS, np.int64))
                    sums[name] += np.bincount(grams[mine], minlength=MODEL_BUCKETS)
                    if len(sums) >= HELD:
                        yield from map(counted, sums.items())
                        sums = {}
        release()
        yield from map(counted, sums.items())

    def counted(item: tuple[str, np.ndarray]) -> pa.RecordBatch:
        at = np.flatnonzero(item[1])
        return pa.RecordBatch.from_arrays([pa.array([item[0]] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(item[1][at])], ["lang", "gram", "n"])

    known = docs.where("lang IS NOT NULL").select("lang", "text")
    n = known.agg(F.count_distinct("lang")).first()[0]
    buckets = MODEL_BUCKETS
    while buckets > LEAST_BUCKETS and buckets * n > MODEL_CELLS:
        buckets //= 2
    rows = known.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", F.expr(f"gram div {MODEL_BUCKETS // buckets}").cast("int").alias("gram")).agg(F.sum("n").alias("n"))
    # a language whose texts hold no word taught nothing
    found = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("grams")).collect()
    found.sort(key=lambda r: r.lang)
    counts = np.zeros((buckets, len(found)))
    for k, r in enumerate(found):
        counts[[g.gram for g in r.grams], k] = [g.n for g in r.grams]
    return Model([r.lang for r in found], counts)


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~found).tolist():
        text = column[k].as_py()
        found[k] = text is not None and any(map(str.isalpha, text))
    return found


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(..., text)`` with text replaced by lang_pred, score, languages and proportions (of the selected set).

    Where ``docs`` has a column of such a name, the added one gets an underscore in front.
    """
    rest = [c for c in docs.columns if c != "text"]
    names = fresh(rest, "lang_pred", "score", "languages", "proportions")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(len(rest))
            data, offsets = string_bytes(column)
            for lo, hi in pieces(offsets, own.piece_bytes):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(rest)]), *_columns(own, column.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])], names=[*rest, *names])

    kinds = [T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())]
    more = [T.StructField(name, kind) for name, kind in zip(names, kinds)]
    return docs.select(*rest, "text").mapInArrow(run, T.StructType([docs.schema[c] for c in rest] + more))


def _columns(model: Model, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    n = len(column)
    known = _has_letter(column, data, offsets) if model.languages else np.zeros(n, bool)
    mix = model.infer(data, offsets) if model.languages else np.zeros((n, 0))
    best = mix.argmax(axis=1) if model.languages else np.zeros(n, np.int64)
    score = np.where(known, mix[np.arange(n), best], 0.0) if model.languages else np.zeros(n)
    pred = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
    order = [[j for j in np.argsort(-row, kind="stable").tolist() if row[j] > 0] if k else [] for row, k in zip(mix, known)]
    sets = [[model.languages[j] for j in o] for o in order]
    shares = [[float(row[j]) for j in o] for row, o in zip(mix, order)]
    return [pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0).astype(float)), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside fold 2 of 4 and predict every row: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "lang", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = learn(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns) without the texts that are in no learned language (``und``), and with ``lang`` as inferred from the text.

    A label that was null or wrong becomes the language with the largest proportion of the document's selected set.
    """
    model = learn(docs.select("lang", "text", (fold(F.col("doc_id"), 4) == 2).alias("out")).where("NOT out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def language(text: pa.Array) -> pa.Array:
        data, offsets = string_bytes(text)
        out = [pa.array([], pa.string())]
        for lo, hi in pieces(offsets, shared.value.piece_bytes):
            out.append(_columns(shared.value, text.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0])
        release()
        return pa.concat_arrays(out)

    # called non-deterministic, so that the filter isn't pushed below it with a second evaluation
    return docs.withColumn("lang", language.asNondeterministic()("text")).where("lang <> 'und'").select(*docs.columns)
