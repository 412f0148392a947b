import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, key int"

WORDS = "the of and red green blue stone river light house tree bird walk sing over under early late small large paper glass".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (rnd.choice([".", ",", ""]) if rnd.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with the awkward cases: nulls in every column, empty and long texts, copies, repeated rows, clashing columns."""
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[1] + " ", texts[2].replace(" ", "\n\t"), None, "", "   ", "123 456", "é", "a" * 5000, prose(rnd, 6000), "x " * 700, "ü" * 300]
    near = texts[60 - 1].split()
    texts += [" ".join(near[:-1] + ["changed"]), " ".join(near)]
    out = [(i, t, rnd.choice(["en", None]), rnd.choice(["s0", None]), len(t) if t is not None else None, "u", 1) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None), (7, "same id, other text", "en", "s", 3, "u", 2)]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
