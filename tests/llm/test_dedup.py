"""Exact copies, near copies, near lines, and the components below them."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import exact_dedup as X
from gridloom.llm import line_dedup as L
from gridloom.llm import linking, simhash

LOW = {i: i + 32 for i in range(65, 91)}


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def union(n, pairs):
    at = list(range(n))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        at[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=400))
@settings(max_examples=30, deadline=None)
def test_cuckoo_index_like_a_dict(steps):
    index, want = X.CuckooIndex(4), {}
    for put, k in steps:
        d = hashlib.sha256(bytes([k])).digest()
        if put:
            index.put(d, k)
            want[d] = k
        else:
            assert index.delete(d) == (want.pop(d, None) is not None)
    assert dict(index.items()) == want and len(index) == len(want)


def test_cuckoo_index_resizes():
    index = X.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, d in enumerate(keys):
        index.put(d, i)
    assert [index.get(d) for d in keys] == list(range(5000)) and index.mask > 1000
    same_tag = [bytes([9]) + bytes(8) + bytes([i]) * 23 for i in range(8)]  # one bucket pair, one tag
    for d in same_tag:
        index.put(d, 1)
    assert all(d in index for d in same_tag) and index.delete(same_tag[3]) and same_tag[3] not in index


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in X.exact_groups(docs).collect())
    want = Counter()
    for text, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want.update((r[0], keep, len(g), hashlib.sha256(text.encode()).hexdigest()) for r in g)
    assert got == want
    assert X.exact_groups(docs).where("kept").count() == len(groups)


def test_drop_exact(docs, no_docs, rows):
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({norm(r[1]) for r in rows}) == len({norm(r.text) for r in kept.collect()})
    assert X.exact_groups(no_docs).count() == X.drop_exact_duplicates(no_docs).count() == 0


def test_live_digests(spark):
    rnd = random.Random(1)
    log = [(i, rnd.choice(["insert", "delete"]), f"t {rnd.randint(0, 20)}") for i in range(500)]
    live = {}
    for seq, op, text in log:
        k = hashlib.sha256(norm(text).encode()).hexdigest()
        live.setdefault(k, seq) if op == "insert" else live.pop(k, None)
    got = X.live_digests(spark.createDataFrame(log, "seq long, op string, text string")).collect()
    assert {r.text_sha256: r.seq for r in got} == live


def test_components(spark):
    rnd = random.Random(3)
    names = [f"{rnd.getrandbits(40):010x}" for _ in range(120)]
    pairs = [(i, i + 1) for i in range(39)] + [(40, i) for i in range(41, 80)] + [(rnd.randrange(80, 120), rnd.randrange(80, 120)) for _ in range(20)]
    tops = union(120, pairs)
    found = {r.id: r.root for r in linking.components(spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a string, b string")).collect()}
    groups = lambda key: {frozenset(n for n in found if key(n) == key(m)) for m in found}
    assert groups(found.get) == groups(lambda n: tops[names.index(n)])


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_close_fingerprints_share_a_block(fp, flips):
    other = fp
    for f in flips:
        other ^= 1 << f
    assert any(fp & m == other & m for m in linking.masks(3))
    assert len(linking.masks(3)) == 20 and len(linking.masks(2)) == 6


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows):
    prints = [plain_fingerprint(r[1], 3) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    tops = union(len(rows), pairs)
    least = {}
    for i, t in enumerate(tops):
        if rows[i][0] is not None:
            least[t] = min(least.get(t, 10**9), rows[i][0])
    want = Counter((r[0], f"{p:016x}", least.get(t)) for r, p, t in zip(rows, prints, tops))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, 3).collect()) == want


def test_crowded_bucket(spark):
    """Hundreds of fingerprints around one, and a chain that leaves their bucket's centre."""
    rnd = random.Random(5)
    base = rnd.getrandbits(62)
    prints = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)} | {base ^ (0b111111 << 40), base ^ (0b111 << 40), rnd.getrandbits(60)}
    prints = sorted(prints)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    tops = union(len(prints), pairs)
    df = simhash.classes(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long"))
    assert {r.fp: r.component_id for r in df.collect()} == dict(zip(prints, tops))


def test_similar_documents(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(20):  # four words replaced: similarity about 0.87
        t = list(texts[i])
        for k in rnd.sample(range(300), 4):
            t[k] = word()
        rows.append((100 + i, " ".join(t)))
    rows += [(200, texts[3][0]), (201, ""), (202, None)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(40)) | {200, 201, 202} and len(kept & set(range(100, 120))) <= 2


def test_drop_near_keeps_columns(docs, no_docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert simhash.drop_near_duplicates(no_docs).count() == simhash.near_duplicates(no_docs).count() == 0


def plain_line(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def word_distance(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def edit_similarity(a, b):
    a, b = a.split(" "), b.split(" ")
    return 1 - word_distance(a, b) / max(len(a), len(b))


def test_line_fingerprint(spark):
    rnd = random.Random(2)
    lines = ["one two three four five", "a b c d e f", "long " + " ".join(f"w{i % 977}" for i in range(1500)), " ".join(rnd.choice(["aa", "bb", "c"]) for _ in range(511)), "x " * 600]
    import pyspark.sql.functions as F

    words = sorted({w for x in lines for w in x.split()})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    found = L.fingerprints(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id").collect()
    assert len(found) == len(lines)
    for r in found:
        own = lines[r.doc_id].split()
        assert r.n == len(own) and 1 <= len(r.blocks) <= L.BLOCKS
        assert r.fp == sum(1 << b for b in range(63) if 2 * sum(hashed[w] >> b & 1 for w in own) > len(own))


def line_groups_by_brute_force(texts, linked):
    """(doc, line, first doc, first line, size, kept) of each line; linked(a, b) for normalised lines."""
    lines = [(d, i, plain_line(x)) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n")) if plain_line(x)]
    distinct = sorted({x for _, _, x in lines})
    pairs = [(i, j) for i in range(len(distinct)) for j in range(i) if linked(distinct[i], distinct[j])]
    top = dict(zip(distinct, union(len(distinct), pairs)))
    first, size = {}, Counter()
    for d, i, x in lines:
        first[top[x]] = min(first.get(top[x], (10**9, 0)), (d, i))
        size[top[x]] += 1
    return {(d, i, *first[top[x]], size[top[x]], (d, i) == first[top[x]]) for d, i, x in lines}


def test_line_groups(spark, docs, rows):
    rnd = random.Random(9)
    base = [" ".join(f"word{rnd.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    texts = []
    for b in base:
        for k in range(6):
            w = b.split()
            for p in rnd.sample(range(60), k + 1):  # up to a tenth of the words
                w[p] = rnd.choice(["other", "x", "more words"])
            texts.append("\n".join([b, " ".join(w), "", "Page  1 ", "\tpage 1", "a b c d e", f"a b {k} d e"]))
    texts += ["for " * n for n in (5, 6, 30, 60)] + ["x " * 700, "x " * 900, "x " * 701, None, "", "a b", "A  b\nb a", "one two three four", "one two three five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = line_groups_by_brute_force(texts, lambda a, b: edit_similarity(a, b) >= 0.8 - 1e-9)
    assert {(r.doc_id, r.line, r.keep_doc, r.keep_line, r.group_size, r.kept) for r in L.line_groups(df).collect()} == want
    assert len({w[2:4] for w in want}) < len({plain_line(x) for t in texts for x in (t or "").split("\n")}) - 40, "the fixture has near lines"
    clean = {r.doc_id: r.text for r in L.drop_repeated_lines(df).collect()}
    assert clean[0].split("\n")[0] == base[0] and not any(base[0] in clean[d] for d in range(1, 36)) and clean[43] is None
    assert L.drop_repeated_lines(docs).columns == docs.columns and L.drop_repeated_lines(docs).count() == len(rows)


def edited(rnd, words, n):
    """``words`` with n of them replaced, dropped, or followed by a new one."""
    out = list(words)
    for p in sorted(rnd.sample(range(len(words)), n), reverse=True):
        new = f"new{rnd.getrandbits(30)}"
        out[p : p + 1] = rnd.choice([[new], [], [out[p], new]])
    return out


def test_similar_lines_are_found(spark):
    """Recall against edit similarity alone: pairs at 0.8 or more, most of them just there, by the number of words."""
    rnd = random.Random(13)
    texts, pairs = [], defaultdict(list)
    for n in (5, 8, 12, 20, 40, 80):
        for _ in range(100):
            a = [f"w{rnd.randrange(3000)}" for _ in range(n)]
            b = edited(rnd, a, max(1, int(0.2 * n)))
            if edit_similarity(" ".join(a), " ".join(b)) >= 0.8:
                pairs[n].append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    first = {r.doc_id: r.keep_doc for r in L.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, some in pairs.items():
        assert len(some) > 25 and sum(first[a] == first[b] for a, b in some) >= 0.9 * len(some), n
    assert all(first[k] // 2 == k // 2 for k in range(len(texts))), "unrelated lines stay apart"


def test_crowded_line_blocks(spark, monkeypatch):
    """Blocks that many unrelated lines share are split by further runs, and lines that resemble each other are still found."""
    monkeypatch.setattr(linking, "CROWDED", 8)
    rnd = random.Random(17)
    common = "all rights reserved by the owner"
    texts = []
    for _ in range(150):
        a = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(8, 24))]
        at = rnd.randrange(len(a))
        a[at:at] = common.split()
        texts += [" ".join(a), " ".join(edited(rnd, a, 2))]
    found = {(r.doc_id, r.keep_doc) for r in L.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {w[:1] + w[2:3] for w in line_groups_by_brute_force(texts, lambda a, b: edit_similarity(a, b) >= 0.8 - 1e-9)}
    assert len(found ^ want) <= 0.05 * len(texts)


@pytest.fixture
def small_files(spark, tmp_path):
    """Documents in several small files, whose packing into tasks follows the session's settings."""
    rnd = random.Random(23)
    word = lambda: f"w{rnd.randrange(4000)}"
    base = [" ".join(word() for _ in range(40)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(base)] + [(300 + i, t) for i, t in enumerate(base[:150])]
    rows += [(rows[7][0], rows[7][1])] * 3
    rnd.shuffle(rows)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(path)
    return path


@pytest.mark.parametrize("drop", [X.drop_exact_duplicates, simhash.drop_near_duplicates, L.drop_repeated_lines])
def test_files_packed_otherwise_between_passes(spark, small_files, drop):
    """The rows that stay are the right ones, though the second pass reads the files in other tasks than the first."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        out = drop(spark.read.parquet(small_files))
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        kept = Counter(r.doc_id for r in out.collect() if r.text)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert kept == Counter(range(300))


def test_text_ids_and_clashing_names(spark):
    """doc_id of another type, and columns named like those that the operators add."""
    rows = [("b", "one two three four five six seven", 1, 2, 3), ("a", "one two  three four five six seven", 1, 2, 3), (None, "One two", 4, 5, 6), ("c", None, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, file long, row long, slot long").withColumnsRenamed({})
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[1], rows[2], rows[3]}
    assert {r.keep_id for r in X.exact_groups(docs).collect()} == {"a", None, "c"}
    assert {tuple(r) for r in simhash.drop_near_duplicates(docs).collect()} == {rows[1], rows[2], rows[3]}
    assert L.drop_repeated_lines(docs).columns == docs.columns


def test_lines_of_nothing(no_docs):
    assert L.line_groups(no_docs).count() == 0


def test_native_plan(spark, docs, capsys):
    L.line_groups(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("n", [1, 3, 7, 126])
def test_plain_fingerprint_sizes(n):
    text = " ".join(f"w{i}" for i in range(n))
    import numpy as np

    assert simhash.fingerprint(np.frombuffer(text.encode(), np.uint8), 3) == plain_fingerprint(text, 3)


def test_similar_documents_by_their_shingles(spark):
    """Pairs on both sides of a Jaccard similarity of 0.8, as close as 0.79 and 0.80."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, copies = [], []
    for i in range(120):
        text = [word() for _ in range(304)]
        n = 33 if i % 2 else rnd.randint(34, 60)  # the tail differs: 300 - n shingles of 300 + n are shared, 0.802 at 33 and 0.796 at 34
        other = text[: 304 - n] + [word() for _ in range(n)]
        rows += [(i, " ".join(text)), (1000 + i, " ".join(other))]
        copies.append((300 - n) / (300 + n) >= 0.8)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(120)) and {1000 + i for i, copy in enumerate(copies) if not copy} <= kept
    assert len(kept & {1000 + i for i, copy in enumerate(copies) if copy}) <= 2


def test_pairs_below_the_limit_are_told_by_their_fingerprints(spark):
    """Of a large group at a similarity of some 0.72, hardly a pair goes on to have its shingles compared; no pair that reaches 0.8 is lost by the parities."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(3000)}" for _ in range(300)]

    def changed(edits):
        words = list(base)
        for at in rnd.sample(range(2, 298), edits):
            words[at] = f"v{rnd.randrange(10**9)}"
        return words

    texts = [changed(6) for _ in range(60)] + [changed(2) for _ in range(30)]
    sets = [{tuple(w[k : k + simhash.SHINGLE]) for k in range(len(w) - simhash.SHINGLE + 1)} for w in texts]
    near = {(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame([(0, i, i, " ".join(w)) for i, w in enumerate(texts)], "file long, row long, doc_id long, text string")
    prints = simhash.wide_fingerprints(rows).cache()
    pairs = prints.alias("a").join(prints.alias("b"), simhash.F.expr("a.row > b.row"))
    side = lambda name: lambda c: simhash.F.col(f"{name}.{c}")
    a, b = side("a"), side("b")
    apart = pairs.select("a.row", "b.row", simhash._differing_shingles(a, b)).collect()
    assert all(d <= len(sets[i] ^ sets[j]) for i, j, d in apart)
    found = {tuple(r) for r in pairs.where(simhash._near_words(a, b)).select("a.row", "b.row").collect()}
    assert len(near) > 400 and len(near - found) <= len(near) // 100
    assert len({p for p in found - near if max(p) < 60}) < 50


def test_lines_that_share_a_crowded_block_alone(spark, monkeypatch):
    """Lines of six words whose one common run is that of hundreds of others: no further run tells them from those."""
    monkeypatch.setattr(linking, "CROWDED", 8)
    rnd = random.Random(41)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for _ in range(120):
        a, tail = word(), f"{word()} {word()}"
        texts += [f"all rights reserved {a} {tail}", f"all rights reserved {word()} {tail}"]
    first = {r.doc_id: r.keep_doc for r in L.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(first[k] // 2 == k // 2 for k in first), "unrelated lines stay apart"
    assert sum(first[k] == first[k + 1] for k in range(0, len(texts), 2)) >= 0.8 * 120


def test_parities_exclude_no_similar_lines(spark):
    """Every pair at 0.8 or more passes the test of parities; of lines that share half of their words, few do."""
    rnd = random.Random(43)
    texts = []
    for n in (5, 10, 25, 60, 120):
        for _ in range(40):
            a = [f"w{rnd.randrange(3000)}" for _ in range(n)]
            texts += [a, edited(rnd, a, max(1, n // 5)), a[: n - n // 2] + [f"v{rnd.randrange(10**6)}" for _ in range(n // 2)]]
    texts = [" ".join(t) for t in texts]
    prints = {r.doc_id: r for r in L.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()}
    odd = lambda i, j: sum(((prints[i][c] ^ prints[j][c]) & (1 << 64) - 1).bit_count() for c in L.ODD)
    most = lambda i, j: 2 * int(0.2 * max(prints[i].n, prints[j].n) + 1e-9) - abs(prints[i].n - prints[j].n)
    for k in range(0, len(texts), 3):
        if edit_similarity(texts[k], texts[k + 1]) >= 0.8:
            assert odd(k, k + 1) <= most(k, k + 1)
    assert sum(odd(k, k + 2) <= most(k, k + 2) for k in range(0, len(texts), 3)) <= 0.2 * len(texts) / 3


def test_pairs_made_of_crowded_line_blocks(spark, monkeypatch):
    """Lines with a phrase in common, and a group of near copies: few pairs are made that aren't linked, and no link is lost."""
    monkeypatch.setattr(linking, "CROWDED", 16)
    made, write = {}, linking.materialize

    def counted(df, label, keep=False):
        out = write(df, label, keep)
        made[label] = out.count()
        return out

    monkeypatch.setattr(linking, "materialize", counted)
    rnd = random.Random(47)
    common, base = "all rights reserved by the owner of this text and of what follows it", [f"w{k}" for k in range(40)]
    texts = [f"{common} " + " ".join(f"w{rnd.randrange(3000)}" for _ in range(10)) for _ in range(200)]
    texts += [" ".join(edited(rnd, base, 3)) for _ in range(200)]
    found = {(r.doc_id, r.keep_doc) for r in L.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {w[:1] + w[2:3] for w in line_groups_by_brute_force(texts, lambda a, b: edit_similarity(a, b) >= 0.8 - 1e-9)}
    assert len(found ^ want) <= 0.02 * len(texts)
    assert made["near-lines-rest"] <= 2 * len(texts), made["near-lines-rest"]
