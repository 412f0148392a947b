"""The pipeline against plain code, stage by stage, and over empty tables."""

import base64
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from gridloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def fixture(rnd):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(rnd.randint(40, 120))) for _ in range(30)]
    items = [(1, " ".join(texts[4].split()[10:25])), (2, "short item here"), (3, None)]
    texts += [texts[0] + "  ", texts[0].replace(" ", "\n"), "prefix " + texts[2] + " suffix", None, "", "123 !", "now a short item here indeed", texts[7], texts[7]]
    edited = texts[9].split()
    edited[20] = "changed"
    texts.append(" ".join(edited))
    return [(i, t, rnd.choice(["en", "fr", None]), None, 1) for i, t in enumerate(texts)], items


def similarity(a, b):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stages(spark, tmp_path):
    rows, items = fixture(random.Random(12))
    rows[0] = (0, rows[0][1], "en", "s", 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r.doc_id for r in kept.collect()}
        if name == "language_id":
            want = {i for i, t in left.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            groups = {}
            for i, t in left.items():
                groups.setdefault(norm(t), []).append(i)
            want = {min(g, key=lambda i: (-len(left[i]), i)) for g in groups.values()}
        elif name == "simhash_dedup":
            want = {i for i in left if not any(j < i and similarity(left[i], left[j]) >= 0.8 for j in left)}
        elif name == "decontaminate":
            windows = [" ".join(items[0][1].split()[k : k + 10]) for k in range(6)] + [items[1][1]]
            want = {i for i, t in left.items() if not any(f" {w} " in f" {t} " for w in windows)}
        else:
            want = set(left)
        assert got == want, name
        left = {i: left[i] for i in got}
        if name != "bpe":
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = kept
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(left[r.doc_id]) and r.n_tokens * 4 == len(r.ids)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in again.collect()} == set(left) and again.columns == docs.columns


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bits_allowed_for_similarity():
    """At a Jaccard similarity of 0.8 the cosine is 0.889 and 15.1 % of the bits differ."""
    share = np.arccos(2 * 0.8 / 1.8) / np.pi
    assert abs(share - 0.151) < 0.001 and 64 * simhash.WIDE * share < simhash.WIDE_BITS < 64 * simhash.WIDE * (share + 0.02)
