"""Decontamination, language, toxicity, language model, chat, tokens: against plain code."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, chat, decontaminate, language_id, lattice_lm, token_files, toxicity
from gridloom.llm.text import string_bytes

from tests.llm.conftest import prose

LOW = {i: i + 32 for i in range(65, 91)}
RANKS = P.path("byte_bpe_50k.tiktoken")


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# decontamination -----------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def plain_contamination(text, items):
    w, hit, names, best = words(text), set(), set(), (0, 1)
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit.update(range(p, p + n))
                    names.add("" if name is None else str(name))
                    if i == 0 or p == 0 or w[p - 1] != v[i - 1]:
                        m = n
                        while p + m < len(w) and i + m < len(v) and w[p + m] == v[i + m]:
                            m += 1
                        best = max(best, (m, -p))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), best[0], -best[1]


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    rnd = random.Random(4)
    out = [(i, " ".join(t.split()[5 : 5 + rnd.randint(8, 30)]).upper()) for i, t in enumerate(texts[:10])]
    return out + [(50, "123-456"), (51, None), (52, ""), (None, out[0][1]), (3, out[3][1]), (60, "ü" * 300), (61, "not in any document at all, I hope, whatever it may say")]


def test_contamination(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = decontaminate.digests(decontaminate.contamination(docs, bench, block_bytes=block)).collect()
        assert Counter(tuple(r) for r in got) == Counter((r[0], *plain_contamination(r[1], items)) for r in rows)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not plain_contamination(r[1], items)[4] for r in rows)


def test_longest_matches(spark):
    doc = "a b " + " ".join(f"w{i}" for i in range(30)) + " c"
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(5, 25)) + " tail"), (2, "b w0 w1")], "item_id long, text string")
    got = decontaminate.longest_matches(spark.createDataFrame([(9, doc)], "doc_id long, text string"), bench).collect()
    assert {tuple(r) for r in got} == {(9, "1", 0, 7, 20), (9, "2", 0, 1, 3)}


def test_contamination_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(no_docs, none).count() == 0


# tokens --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_rows(docs, no_docs, rows, library):
    got = Counter(tuple(r) for r in bpe.round_trip_digests(docs, RANKS).collect())
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(no_docs, RANKS).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), RANKS), RANKS)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, P.PATTERN)


@given(st.lists(st.text(st.sampled_from("aeinrst  '\n1.é🙂漢"), max_size=60), max_size=20))
@settings(max_examples=60, deadline=None)
def test_bpe_like_the_library(encoder, library, texts):
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode_ordinary(t) for t in texts]


def test_long_pretokens(encoder, library):
    rnd = random.Random(6)
    texts = ["a" * 50_001, "ab" * 30_000, "".join(rnd.choice("aeinrst") for _ in range(40_000)), "é" * 9_999]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode_ordinary(t) for t in texts]
    word = "".join(rnd.choice("aeinrst") for _ in range(2000))
    assert encoder.vocabulary.encode_piece(word.encode()) == library.encode_ordinary(word)


@given(st.lists(st.integers(0, 2**18 - 1), max_size=300))
def test_rank_bitmap(ranks):
    bitmap = bpe.RankBitmap()
    for r in ranks:
        bitmap.set(r)
    assert [bitmap.pop_first() for _ in set(ranks)] == sorted(set(ranks)) and bitmap.pop_first() == -1


@given(st.integers(1, 24), st.data())
def test_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=200)), np.int32)
    packed = token_files.pack(ids, bits)
    assert token_files.unpack(packed, bits, len(ids)).tolist() == ids.tolist() and len(packed) == -(-len(ids) * bits // 8)


def test_token_files(docs, no_docs, rows, tmp_path):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    files = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/t", file_ids=3000)
    got = sorted((tuple(r) for r in token_files.read_token_files(docs.sparkSession, files).collect()), key=lambda r: r[1])
    at, want, every = 0, [], []
    for r in order:
        ids = [*own.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
        at += len(ids)
    assert got == want and len(files) > 1
    file = token_files.TokenFile(files[0][0])
    assert file.bits == 16 and file.ids(5, 900).tolist() == every[5:900] and file.document(2).tolist() == every[want[2][1] : want[3][1]]
    assert token_files.token_rows(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(TypeError):
        token_files.token_rows(no_docs.withColumn("doc_id", F.lit("a")), P.path("byte_bpe_50k.json"))


def test_library_pieces():
    own, library = token_files.LibraryEncoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab  \n\t\r1'.,sd’é \xa0<|>") for _ in range(rnd.randint(0, 40))) for _ in range(5000)] + ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "<|endoftext", "", "x" * 4000, "it's we'll  'S"]
    ids, at = own.encode(*string_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def unlike_words(n=11):
    """Two words of 2**n letters that polynomial hashes modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_are_known_by_their_bytes(spark):
    path = P.path("byte_bpe_50k.json")
    for n in (10, 11):
        one, two = unlike_words(n)
        own, library = token_files.LibraryEncoder(path), Tokenizer.from_file(path)
        for t in (one, two):  # the second one after the first is remembered
            assert own.encode(*string_bytes(pa.array([t])))[0].tolist() == library.encode(t, add_special_tokens=False).ids
        docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y")], "doc_id long, text string")
        bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
        assert {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench).collect()} == {1: ["1"], 2: ["2"]}
        learned = spark.createDataFrame([(1, one, True, False), (2, two, False, False)], "doc_id long, text string, t boolean, d boolean")
        known = {r.doc_id: r.n_known for r in lattice_lm.score(learned, P.path("piece_bpe_32k.model"), "t", "d").collect()}
        assert known == {1: 2, 2: 1}


# language model ------------------------------------------------------------------------------------------


def marginal(word, pieces):
    best = [0.0] * (len(word) + 1)
    best[0] = 1.0
    for j in range(1, len(word) + 1):
        best[j] = sum(best[i] * pieces.get(word[i:j], 0.0) for i in range(j))
    return best[-1]


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        yield from ([word[:k], *rest] for rest in segmentations(word[k:]))


def test_lattice_against_all_segmentations():
    names = [b"a", b"b", b"c", b" ", b" a", b"ab", b"abc", b"bca", b"cab", b" ab"]
    rnd = random.Random(0)
    p = np.array([rnd.random() for _ in names])
    p /= p.sum()
    lattice = lattice_lm.Lattice(sorted(names), np.log(p))
    pieces = dict(zip(sorted(names), p.tolist()))
    tested = [b" abcab", b" a", b"c", b" bcabcabc", b" " + b"abc" * 4]
    got, expected = lattice.run(tested, np.array([1, 2, 3, 1, 1]))
    total = np.zeros(len(names))
    for w, z, c in zip(tested, got, [1, 2, 3, 1, 1]):
        ways = [s for s in segmentations(w) if all(x in pieces for x in s)]
        weight = [math.prod(pieces[x] for x in s) for s in ways]
        assert math.exp(z) == pytest.approx(sum(weight)) == pytest.approx(marginal(w, pieces))
        for s, v in zip(ways, weight):
            for x in s:
                total[sorted(names).index(x)] += c * v / sum(weight)
    assert expected == pytest.approx(total)
    long = b" " + b"abc" * 200
    one, e = lattice.run([long], np.array([1]))
    more = lattice_lm.Lattice(sorted(names), np.log(p))
    want = np.zeros(len(names))
    assert one[0] == pytest.approx(more._single(long, want, 1.0)) and e == pytest.approx(want)
    assert sum(n * k for n, k in zip([len(x) for x in sorted(names)], e)) == pytest.approx(len(long))


def test_scores(docs, no_docs, rows):
    path = P.path("piece_bpe_32k.model")
    got = lattice_lm.score_documents(docs, path).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    counts = Counter()
    for r in rows:
        if fold(r[0], 10):
            counts.update([*split(r[1]), "\0"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = [*split(r[1]), "\0"]
        want[r[0], fold(r[0], 10) == 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and r.mixed_score < 0 for r in got)
    few = lattice_lm.score(docs.withColumn("t", F.lit(True)).withColumn("d", F.col("doc_id") % 5 == 0).select("doc_id", "text", "t", F.coalesce("d", F.lit(False)).alias("d")), path, "t", "d", frequent=3)
    assert few.count() == len(rows)
    assert lattice_lm.score_documents(no_docs, path).count() == 0


def test_document_probability_by_brute_force(spark):
    """Whole documents: the sum over all segmentations of all words, under pieces learned from all segmentations of the training words."""
    path = P.path("piece_bpe_32k.model")
    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice(["ab", "The", "cat", "sat.", "é", "to", "a"]) for _ in range(rnd.randint(0, 6)))) for i in range(40)] + [(90, "unseen xq"), (91, None)]
    got = lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    surfaces, logp = lattice_lm.vocabulary_pieces(path)
    existing = dict(zip(surfaces, np.exp(logp).tolist()))
    split = lambda t: [b" " + w.encode() for w in (t or "").translate(LOW).split(" ") if w]
    counts, n_docs = Counter(), 0
    for i, t in rows:
        if fold(i, 10):
            counts.update(split(t))
            n_docs += 1
    uses = Counter()
    for w, c in counts.items():
        ways = [(s, math.prod(existing[x] for x in s)) for s in segmentations(w) if all(x in existing for x in s)]
        for s, p in ways:
            for x in s:
                uses[x] += c * p / sum(p for _, p in ways)
    weight = {x: lattice_lm.PRIOR_PIECES * p + uses[x] for x, p in existing.items()}
    whole = sum(weight.values())
    learned = {x: w / whole for x, w in weight.items()}
    stop = n_docs / (n_docs + sum(counts.values()))
    for r in got:
        text = dict(rows)[r.doc_id]
        for score, pieces in ((r.score, learned), (r.existing_score, existing)):
            want = math.log10(stop) + sum(math.log10((1 - stop) * marginal(w, pieces)) for w in split(text))
            assert score == pytest.approx(want, abs=1e-6), text


def test_held_out_probability(spark):
    """Unseen texts of the training distribution get a higher probability than shuffled letters."""
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 80)) for i in range(200)] + [(1000 + i, "".join(rnd.sample(prose(rnd, 80), 300))) for i in range(20)]
    got = lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()
    per = lambda rs: sum(r.score for r in rs) / sum(r.n_tokens for r in rs)
    assert per([r for r in got if r.held_out and r.doc_id < 1000]) > per([r for r in got if r.doc_id >= 1000]) + 1


# language ------------------------------------------------------------------------------------------------

TONGUES = {"aa": "kata moro pili tunu saba rako", "bb": "strem plinch grost vadsk thrumb", "cc": "éloué çaré être réaux ouçé"}


def tongue(rnd, lang, n):
    return " ".join(rnd.choice(TONGUES[lang].split()) for _ in range(n))


def test_language(spark, no_docs):
    rnd = random.Random(1)
    rows = [(i, tongue(rnd, lang, rnd.randint(3, 60)), lang) for i in range(300) for lang in [rnd.choice(list(TONGUES))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 — 34!", "aa"), (903, "x" * 9_000_000, None), (None, tongue(rnd, "aa", 20), None), (904, tongue(rnd, "bb", 30) + " " + tongue(rnd, "cc", 10), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    known = {r[0]: r[2] for r in rows}
    assert len(held) > 40 and all(r.lang_pred == known[r.doc_id] and r.score > 0.9 for r in held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[None].lang_pred == "aa" and by[903].lang_pred in TONGUES
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    model = language_id.learn(df)
    mixed = language_id.identify(df.where("doc_id = 904").select("doc_id", "text"), model).first()
    assert mixed.languages == ["bb", "cc"] and mixed.proportions == pytest.approx([0.75, 0.25], abs=0.02)
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id: r.lang for r in kept.collect()} == {r.doc_id: r.lang_pred for r in got if r.lang_pred != "und"}
    assert language_id.predict(no_docs).count() == 0
    unlabelled = language_id.predict(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlabelled] == [("und", 0.0)]


def test_mixture_by_brute_force():
    """Proportions against a plain expectation-maximisation over one document's words, and the selected set against all sets."""
    rnd = random.Random(8)
    langs = list(TONGUES)
    counts = np.zeros((language_id.MODEL_BUCKETS, 3))
    for k, lang in enumerate(langs):
        data, at = string_bytes(pa.array([tongue(rnd, lang, 500)]))
        counts[:, k] = np.bincount(language_id.trigrams(data, at), minlength=language_id.MODEL_BUCKETS)
    model = language_id.Model(langs, counts)
    for parts in ((30, 0, 0), (20, 10, 0), (15, 10, 5)):
        text = " ".join(tongue(rnd, lang, n) for lang, n in zip(langs, parts) if n)
        mix = model.infer(*string_bytes(pa.array([text])))[0]
        like = []
        for w in text.encode().split():
            grams = language_id.trigrams(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
            like.append(np.exp(model.logp[grams].sum(axis=0, dtype=float)))
        like, found = np.array(like), {}
        for bits in range(1, 8):
            m = np.array([bits >> k & 1 for k in range(3)], float)
            m /= m.sum()
            for _ in range(60):
                share = like * m
                m = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
            found[bits] = np.log((like * m).sum(axis=1)).sum() - 0.5 * np.log(len(like) + 1) * bin(bits).count("1"), m
        best = max(found.values(), key=lambda x: x[0])[1]
        assert set(np.flatnonzero(mix)) == set(np.flatnonzero(best)) and mix == pytest.approx(best, abs=0.01)


def test_any_number_of_languages(spark):
    """A column full of odd labels: 300 languages, and columns named like those that are added."""
    rnd = random.Random(4)
    word = lambda k: "".join(chr(97 + (k * 7 + rnd.randrange(3) * 5 + j * k) % 26) for j in range(5))
    rows = [(i, " ".join(word(i % 300) for _ in range(30)), f"l{i % 300:03d}", 1) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language_id.predict(df.drop("score")).collect()
    assert len(got) == 1200 and {r.lang_pred for r in got} <= {r[2] for r in rows}
    out = language_id.identify(df.limit(2), language_id.learn(df))
    assert out.columns == ["doc_id", "lang", "score", "lang_pred", "_score", "languages", "proportions"] and out.count() == 2


def test_large_document_as_its_distinct_words():
    rnd = random.Random(3)
    counts = np.zeros((language_id.MODEL_BUCKETS, 2))
    for k, lang in enumerate(("aa", "bb")):
        data, at = string_bytes(pa.array([tongue(rnd, lang, 500)]))
        counts[:, k] = np.bincount(language_id.trigrams(data, at), minlength=language_id.MODEL_BUCKETS)
    model = language_id.Model(["aa", "bb"], counts)
    args = string_bytes(pa.array([tongue(rnd, "aa", 40) + " " + tongue(rnd, "bb", 60)]))
    whole = model.infer(*args)
    old, language_id.LARGE = language_id.LARGE, 10
    try:
        assert model.infer(*args) == pytest.approx(whole, abs=1e-4)
    finally:
        language_id.LARGE = old


# toxicity ------------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.folded("ІDІОТ 1d10t 2024 Ｃｌｏｗｎ") == "idiot idiot 2024 clown"
    one = toxicity.Lexicon({"idiot": 3.0, "scum*": 2.0}, ["idiot board"]).automaton()
    assert toxicity.matched("an idiot, idiotic; scummy", one) == (5.0, 2)
    assert toxicity.matched("the idiot board", one) == (0, 0)
    assert toxicity.matched("", one) == (0, 0) and toxicity.matched("x", toxicity.Lexicon().automaton()) == (0.0, 0)


def test_toxicity(spark, no_docs):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w, bad = prose(rnd, rnd.randint(20, 80)).split(), rnd.random() < 0.25
        for _ in range(3 if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["moron", "idiot", "m0ron", "grublax" + rnd.choice("abcdef")]))
        rows.append((i, " ".join(w)))
        if i < 500:
            labels.append((i, int(bad)))
    rows += [(700, None), (701, ""), (None, "idiot idiot"), (0, "a second text of document 0")]
    labels += [(None, 1), (5, None), (labels[7][0], labels[7][1])]
    df, lf = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {(r.doc_id, r.held_out, r.predicted): r for r in toxicity.score_documents(df, lf).collect()}
    known = dict(x for x in labels if x[0] is not None and x[1] is not None)
    held = [r for r in got.values() if r.held_out and r.doc_id in known]
    assert len(held) > 60 and sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    lexicon = toxicity.learn(df, lf)
    assert {"moron", "idiot"} <= set(lexicon.terms) and any(t.startswith("grubl") and t.endswith("*") for t in lexicon.terms)
    assert toxicity.score_documents(df, lf.where("toxic = 0")).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_documents(no_docs, lf).count() == 0
    assert toxicity.score_documents(df, lf.limit(0)).count() == len(rows)


def test_toxicity_by_brute_force(spark):
    """Scores of a given lexicon against plain code, and names that clash."""
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum*": 2.0, "scummy": 2.5}, ["idiot board"], (-2.0, 1.0, 0.5, 0.25))
    texts = ["you idiot", "1D10T idiot board scummy, scummiest", "", None, "clean " * 50 + "scum", "idiotic discum", "idiot " * 30]

    def plain(text):
        hits, found = 0.0, 0
        tokens = re.findall(r"[a-z]+", (text or "").lower().replace("1d10t", "idiot"))
        for i, w in enumerate(tokens):
            x = {"idiot": 3.0, "scummy": 2.5}.get(w, 2.0 if w.startswith("scum") else 0.0)
            if w == "idiot" and tokens[i + 1 : i + 2] == ["board"]:
                x = 0.0
            hits, found = hits + x, found + (x > 0)
        density = 10 * hits / (len((text or "").split()) + toxicity.LENGTH_PSEUDO) if text else 0.0
        return 1 / (1 + math.exp(-(-2.0 + density + 0.5 * math.sqrt(density) + 0.25 * min(found, 3) / 3)))

    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    out = toxicity.score(df, lexicon)
    assert out.columns == ["doc_id", "score", "_score", "predicted"]
    for r in out.collect():
        assert r._score == pytest.approx(plain(texts[r.doc_id])) and r.predicted == (r._score >= 0.5) and r.score == "own"


# chat ----------------------------------------------------------------------------------------------------


def call(i, name, arguments):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": arguments}}


def test_chat(spark):
    schema = {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}}, "required": ["city"], "additionalProperties": False}
    tools = json.dumps({"content": "sys", "tools": [{"function": {"name": "weather", "parameters": schema}}]})
    result = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    rows = [
        (1, 0, "system", tools), (1, 1, "user", "Hi {"), (1, 2, "assistant", json.dumps({"tool_calls": [call("c2", "plan", {"from": {"$ref": "c1"}})]})),
        (1, 3, "tool", result("c1", "sunny")), (1, 4, "assistant", json.dumps({"content": None, "tool_calls": [call("c1", "weather", '{"days": 2, "city": "Ulm"}'), call("c3", "weather", {"town": 1})]})),
        (1, 5, "tool", result("c2", {"b": 1, "a": [2.0, "é"]})), (1, 6, "tool", result("zz", "?")), (1, 7, "tool", result("c1", "again")),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("x", "f", {"$ref": "y"})]})), (2, 1, "assistant", json.dumps({"tool_calls": [call("y", "f", {"$ref": "x"})]})),
        (3, 0, None, None), (3, None, "user", '{"a": 1e999, "b": "\\ud800"}'), (None, 1, "tool", result("c1", "no conversation")), (3, 1, "assistant", '{"tool_calls": [{"id": "q", "function": {"name": "f", "arguments": "{bad"}}]}'),
        (4, 0, "assistant", "[" * 5000), (4, 1, "assistant", "x" * 300_000), (4, 1, "assistant", "x" * 300_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_messages(df).cache()
    assert out.count() == len(rows)
    one = sorted(out.where("conv_id = 1").collect(), key=lambda r: (r.order_turn, r.order_step, r.turn, r.json))
    assert [r.turn for r in one][:3] == [0, 1, 4] and [r.turn for r in one].index(4) < [r.turn for r in one].index(3) < [r.turn for r in one].index(5)
    assert [r.turn for r in one].index(4) < [r.turn for r in one].index(2) < [r.turn for r in one].index(5)
    by = {r.turn: r for r in one}
    assert (by[4].n_calls, by[4].n_linked, by[4].n_invalid) == (2, 1, 1) and by[2].n_linked == 1
    assert [by[t].status for t in (3, 5, 6, 7)] == ["ok", "ok", "unmatched result", "duplicate result"]
    assert json.loads(by[4].json)["tool_calls"][1]["validation"] == "$.city: missing; $.town: unknown"
    assert by[5].json == '{"content":"{\\"a\\":[2.0,\\"é\\"],\\"b\\":1}","role":"tool","tool_call_id":"c2"}'
    assert {r.status for r in out.where("conv_id = 2").collect()} == {"cyclic"}
    three = {r.turn: r for r in out.where("conv_id = 3").collect()}
    assert three[0].role == "unknown" and json.loads(three[1].json)["tool_calls"][0]["validation"] == "malformed arguments"
    assert out.where("conv_id IS NULL").first().status == "unmatched result"
    for r in out.collect():
        assert r.json == chat.canonical(json.loads(r.json))
    deep = chat.format_messages(spark.createDataFrame([(1, 1, "assistant", '{"a":' * 200 + "1" + "}" * 200)], "conv_id long, turn long, role string, text string")).first()
    assert deep.status == "too deep" and json.loads(deep.json)["content"].startswith('{"a":')
    whole = chat.transcripts(out, segment=3).where("conv_id = 1").orderBy("segment").collect()
    assert [len(json.loads(r.messages)) for r in whole] == [3, 3, 2] and json.loads(whole[0].messages)[0]["role"] == "system"
    assert chat.format_messages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "value, schema, bad",
    [(1, {"type": "string"}, 1), (True, {"type": "integer"}, 1), (2.0, {"type": "integer"}, 0), (None, {"type": ["null", "string"]}, 0), ("a", {"enum": ["a", "b"]}, 0), ("c", {"enum": ["a", "b"]}, 1),
     ([1, "x"], {"items": {"type": "number"}}, 1), (3, {"minimum": 4, "maximum": 2}, 2), (4, {"exclusiveMinimum": 4}, 1), (0.3, {"multipleOf": 0.1}, 0), (7, {"multipleOf": 2}, 1), ("abc", {"pattern": "^b", "maxLength": 2}, 2), ("", {"minLength": 1}, 1),
     ([1, 1.0], {"uniqueItems": True, "minItems": 3}, 2), ([1, "a"], {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, 0), (1, {"const": 1.0}, 0), (2, {"anyOf": [{"const": 1}, {"type": "string"}]}, 1), (2, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}, 1),
     (2, {"allOf": [{"type": "integer"}, {"minimum": 5}]}, 1), (2, {"not": {"type": "integer"}}, 1), ({"ab": 1}, {"patternProperties": {"^a": {"type": "string"}}, "additionalProperties": False}, 1), ({"ab": 1}, {"propertyNames": {"maxLength": 1}, "minProperties": 2}, 2), (1, False, 1), ({"a": {"b": 1}}, {"properties": {"a": {"required": ["c"]}}}, 1), ({"$ref": "r"}, {"type": "string"}, 0), ({"x": 1}, {"additionalProperties": {"type": "string"}}, 1), (1, True, 0)],
)
def test_schema(value, schema, bad):
    check = chat.Check(value, schema)
    assert len(check.found) == bad and not check.unknown


def test_unknown_keywords_are_told():
    assert chat.verdict('{"a":"x"}', '{"properties":{"a":{"format":"email","title":"A"}},"if":{},"then":{}}') == "unchecked: format, if, then"
    assert chat.verdict('{"a":1}', '{"properties":{"a":{"type":"string","format":"email"}}}') == "$.a: not string"
    assert chat.verdict('"x"', '{"pattern":"("}') == "unchecked: pattern" and chat.verdict("1", "{}") == "valid"


def test_results_come_before_the_calls_that_need_them(spark):
    """Random conversations: in the order of the output, each linked result stands behind its call and before every call that refers to it."""
    rnd = random.Random(19)
    rows, needs, turns = [], {}, {}
    for conv in range(12):
        n = rnd.randint(2, 9)
        turn = rnd.sample(range(40), 2 * n)
        for k in range(n):
            needs[conv, k] = rnd.sample(range(k), min(k, rnd.randint(0, 2)))
            turns[conv, k] = turn[2 * k : 2 * k + 2]
            rows.append((conv, turn[2 * k], "assistant", json.dumps({"tool_calls": [call(f"c{k}", "f", [{"$ref": f"c{j}"} for j in needs[conv, k]])]})))
            if rnd.random() < 0.8:
                rows.append((conv, turn[2 * k + 1], "tool", json.dumps({"tool_call_id": f"c{k}", "content": "r"})))
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    place = {}
    for conv in range(12):
        for p, r in enumerate(sorted((r for r in out if r.conv_id == conv), key=lambda r: (r.order_turn, r.order_step, r.turn, r.json))):
            place[conv, r.turn] = p
    for (conv, k), others in needs.items():
        for j in others:
            for t in turns[conv, j]:
                assert place[conv, turns[conv, k][0]] > place.get((conv, t), -1)
        assert place.get((conv, turns[conv, k][1]), 99) > place[conv, turns[conv, k][0]]
    late = chat.format_messages(spark.createDataFrame([(1, 1, "assistant", json.dumps({"tool_calls": [call("x", "f", {})]})), (1, 2, "assistant", json.dumps({"tool_calls": [call("y", "f", {"$ref": "x"})]})), (1, 5, "tool", json.dumps({"tool_call_id": "x", "content": ""}))], "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted(late, key=lambda r: (r.order_turn, r.order_step))] == [1, 5, 2]


def test_chat_levels(spark):
    """Chains of any depth, several references, cycles and what lies behind them, against plain recursion."""
    rnd = random.Random(4)
    needs = {(1, k): {k - 1} if k else set() for k in range(1500)}
    needs |= {(2, k): set(rnd.sample(range(k), min(k, rnd.randint(0, 3)))) for k in range(40)}
    needs |= {(3, k): {k - 1, k - 2} if k > 1 else set() for k in range(12)}
    needs |= {(4, k): {(k + 1) % 7} for k in range(7)} | {(4, k): {k - 1, 20} for k in range(7, 20)} | {(4, 20): set(), (4, 21): {21}}
    turn = {key: rnd.randrange(3000) for key in needs}
    level, at = {key: -1 for key in needs}, dict(turn)
    while ready := [(c, k) for c, k in needs if level[c, k] < 0 and all(level[c, n] >= 0 for n in needs[c, k])]:
        for c, k in ready:
            level[c, k] = max([level[c, n] + 1 for n in needs[c, k]], default=0)
            at[c, k] = max([turn[c, k], *(at[c, n] for n in needs[c, k])])
    uids = {key: i for i, key in enumerate(needs)}
    rows = [(uids[c, k], c, turn[c, k], str(k), [str(n) for n in sorted(needs[c, k])]) for c, k in needs]
    none = spark.createDataFrame([], "conv_id long, id string, turn long")
    found = chat._levels(spark.createDataFrame(rows, "uid long, conv_id long, turn long, id string, refs array<string>"), none).collect()
    assert {r.uid: (r.level, r.at) for r in found} == {uids[key]: (level[key], at[key]) for key in needs}
    assert level[1, 1499] == 1499 and {level[4, k] for k in range(20)} == {-1} and len(found) == len(needs)
