"""Documents with the cases every operator must bear."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, block string, epoch string, row string, _row string"


def prose(rng, n, words=400):
    pool = [f"{a}{b}{c}" for a in ("ba", "de", "lo", "mi", "ru", "ta", "vo") for b in ("n", "r", "st", "l") for c in ("a", "e", "ion", "ul", "et")]
    common = ["the", "of", "and", "to", "in"]
    out = [rng.choice(common) if rng.random() < 0.3 else rng.choice(pool[:words]) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 11 == 10 else w for i, w in enumerate(out))


def make_texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    shared = prose(rng, 80)
    texts = [*base, base[3], base[3], base[4] + " extra end", shared, base[5] + "\n" + shared, "lead " + shared + " tail"]
    texts += [None, "", " ", "\n\n", "one", "a b", "ÀÉ ß Σας 🙂 word", "tab\there  double  space", "x" * 3000, "ab " * 400, prose(rng, 9000), base[3]]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Null identifiers, texts, sources and languages; repeated rows; extra columns that bear internal names."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], len(t or ""), "k", "b", "e", "r", "q") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[1], "en", "s1", 0, None, None, None, None, None), (None, texts[7], "en", "s3", 0, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
