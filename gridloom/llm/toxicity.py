"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other alphabets to Latin ones, accents of compatibility forms
dropped, and, in words that hold a letter, digits to the letters that they stand for. The lexicon holds words and word
beginnings; each match counts with its term's weight (of several matches in a word the heaviest), matches
inside an exception phrase count nothing, and the sum is normalised by length. A logistic curve makes it a score.

The lexicon, the exceptions and the curve are fitted on at most SAMPLE_ROWS labelled documents (those with the least
hash of doc_id; lexicon from three quarters of them, curve from the rest), so what is broadcast and what reaches
the driver is bounded by that parameter: SAMPLE_ROWS labels, the terms and phrases that MIN_DOCS or EXCEPTION_DOCS of those documents have, a few
numbers per calibration row. Scoring is one pass over the texts without a shuffle.

A null text is an empty one: nothing matches, and the curve's value at zero is its score. Several labels of a doc_id:
toxic if any is. Several texts of a doc_id: the least one is learned from. Null labels and doc_ids teach nothing. Without both labels in the sample the score is the share of
toxic rows in it, or 0 without rows. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh, materialize

SAMPLE_ROWS = 20_000
MIN_DOCS = 5
MIN_WEIGHT = 2.0
PREFIXES = range(4, 10)
EXCEPTION_DOCS = 5
#: Words added to a text's length, so that one match in a very short text doesn't count as a whole text of them.
LENGTH_PSEUDO = 20.0

#: Letters of other alphabets (Cyrillic, Greek, Armenian, phonetic) that look like Latin ones, and the digits that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнԛԝѵүґгзё" "αεορντυκιχγβηωσςζμάέίόύώ" "օոսցհզ" "ıɑɡɩʏʀɴʟʜɪ", "aeopcyxijsdhkmtbhqwvyrrze" "aeopvtukixybnwoczuaeiouw" "onughq" "iagiyrnlhi"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_FOLD = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(DIGITS)
_DIGIT_WORD = re.compile(r"\w*[^\W\d_]\w*")
_HAS_DIGIT = re.compile(r"[0-9](?=[^\W\d_])|[^\W\d_][0-9]")
_WORDS = re.compile(r"[^\W_]+")
_HOMOGLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_COMPAT = re.compile("[ᴀ-ᶿ℀-⅏＀-￯\U0001d400-\U0001d7ff]")


def folded(text: str) -> str:
    if not text.isascii() and _COMPAT.search(text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _HOMOGLYPH.search(text):
        text = text.translate(_FOLD)
    if _HAS_DIGIT.search(text):
        text = _DIGIT_WORD.sub(lambda m: m[0].translate(_LEET), text)
    return text


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings (written with a final ``*``), and exception phrases."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0,)
    constant: float | None = None

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, list] = {}
        for term, weight in self.terms.items():
            found.setdefault(term.rstrip("*"), [0.0, 0.0, False])[1 if term.endswith("*") else 0] = weight
        for phrase in self.exceptions:
            found.setdefault(folded(phrase), [0.0, 0.0, False])[2] = True
        out = ahocorasick.Automaton()
        for text, (whole, start, exempt) in found.items():
            if text:
                out.add_word(text, (len(text), whole, start, exempt))
        if len(out):
            out.make_automaton()
        return out


def matched(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """(weight of the matches in a folded text, words with a match)."""
    if not len(automaton):
        return 0.0, 0
    hits: dict[int, float] = {}
    exempt: list[tuple[int, int]] = []
    n = len(text)
    for end, (size, whole, start, phrase) in automaton.iter(text):
        begin = end - size + 1
        if begin and text[begin - 1].isalnum():
            continue
        closed = end + 1 == n or not text[end + 1].isalnum()
        weight = max(whole if closed else 0.0, start)
        if weight > 0:
            hits[begin] = max(hits.get(begin, 0.0), weight)
        if phrase and closed:
            exempt.append((begin, end))
    for a, b in exempt:
        for at in [h for h in hits if a <= h <= b]:
            del hits[at]
    return sum(hits.values()), len(hits)


def _inputs(text: str | None, automaton) -> tuple[float, float, float]:
    """What the curve gets: density of weight, its root, and whether there is a match at all."""
    if not text:
        return 0.0, 0.0, 0.0
    weight, n = matched(folded(text), automaton)
    density = 10 * weight / (len(text.split()) + LENGTH_PSEUDO)
    return density, math.sqrt(density), min(n, 3) / 3


def _features(text: str) -> set[str]:
    words = set(_WORDS.findall(folded(text)))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents: (toxic, fit, text), written down. The broadcast side is bounded by ``rows``."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(4)) != 0
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    return materialize(found.select("toxic", fit.alias("fit"), "text"), "sample")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    sample = _sample(docs, labels, sample_rows)
    sizes = {(r.fit, r.toxic): r.n for r in sample.groupBy("fit", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all = sum(sizes.values())
    toxic, clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not toxic or not clean:
        share = sum(n for (_, t), n in sizes.items() if t) / n_all if n_all else 0.0
        return Lexicon(constant=share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (bad if label else good).update(_features(text))
        terms = list(bad)  # a term that no toxic row has can't enter the lexicon
        others = [t for t in good if t not in bad]
        for part in (terms, others):
            for k in range(0, len(part), 50_000):
                p = part[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array([bad[t] for t in p], pa.int64()), pa.array([good[t] for t in p], pa.int64())], ["term", "bad", "good"])

    counts = sample.where("fit").select("toxic", "text").mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    rows = counts.where(F.col("bad") >= MIN_DOCS).withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT)
    terms = _prune({r.term: (r.w, r.bad) for r in rows.collect()})
    lexicon = Lexicon(terms)
    lexicon.exceptions = _exceptions(sample.where("fit").select("toxic", "text"), lexicon)
    return _calibrate(sample.where("NOT fit").select("toxic", "text"), lexicon)


def _prune(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Drops a word beginning that a longer beginning or a word explains: one of about as many rows and no less weight."""
    out, names = {}, sorted(found)
    for term in names:
        w, n = found[term]
        if term.endswith("*"):
            longer = takewhile(lambda o: o.startswith(term[:-1]), (names[k] for k in range(bisect_left(names, term[:-1]), len(names))))  # noqa: B023
            if any(o != term and found[o][1] >= 0.9 * n and found[o][0] >= w for o in longer):
                continue
        out[term] = w
    return out


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around a match that EXCEPTION_DOCS clean rows have and no toxic row does."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = folded(text)
                if not matched(low, automaton)[1]:
                    continue
                spots = [m.span() for m in _WORDS.finditer(low)]
                hit = [matched(low[a:b], automaton)[1] > 0 for a, b in spots]
                near = {low[spots[i][0] : spots[i + 1][1]] for i in range(len(spots) - 1) if hit[i] or hit[i + 1]}
                for p in near:
                    counts.setdefault(p, [0, 0])[int(label)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["phrase", "good", "bad"])

    sums = rows.mapInArrow(phrases, "phrase string, good long, bad long").groupBy("phrase").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return sorted(r.phrase for r in sums.where(f"bad = 0 AND good >= {EXCEPTION_DOCS}").collect())


def _calibrate(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The logistic curve by ridge-penalised Newton steps on the calibration rows (at most SAMPLE_ROWS of four numbers)."""

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([_inputs(t, automaton) for t in batch.column(1).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3))], ["y", "a", "b", "c"])

    found = np.array([tuple(r) for r in rows.mapInArrow(inputs, "y int, a double, b double, c double").collect()], float).reshape(-1, 4)
    y, x = found[:, 0], np.column_stack([np.ones(len(found)), found[:, 1:]])
    if len(set(y.tolist())) < 2:
        # no calibration rows of one label: half a unit of density is the limit
        lexicon.curve = (-4.0, 4.0, 4.0, 0.0)
        return lexicon
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-6, 0.1, 0.1, 0.1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
    lexicon.curve = tuple(beta.tolist())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs(..., text)`` with text replaced by score and predicted; one that clashes gets an underscore in front."""
    rest = [c for c in docs.columns if c != "text"]
    score, predicted = fresh(rest, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        automaton, curve = own.automaton(), np.array(own.curve)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                if own.constant is not None:
                    s = np.full(part.num_rows, own.constant)
                else:
                    x = np.array([(1.0, *_inputs(t, automaton)) for t in part.column(len(rest)).to_pylist()], float).reshape(-1, 4)
                    s = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*rest, "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside fold 0 of 5 and score every row: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score(docs, learn(docs.where("NOT held_out"), labels))
