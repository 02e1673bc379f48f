import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, th string, line int, label string, items string"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", 1, "z", "w")


def words(rnd, n, pool=400):
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, blanks, ties, copies, near copies, one long text and columns of clashing names."""
    rnd = random.Random(7)
    base = [words(rnd, rnd.randrange(1, 120)) for _ in range(60)]
    rows = [row(i, t, rnd.choice(["en", "de", None]), f"s{i % 3}") for i, t in enumerate(base)]
    rows += [row(100 + i, base[5]) for i in range(40)]
    rows += [row(200 + i, base[7] + f" tail{i}") for i in range(10)]
    rows += [row(300, None), row(301, ""), row(302, " \n\t "), row(303, "Ünïcode Straße ÉTÉ 東京 word"), row(None, base[3]), row(None, None)]
    rows += [row(304, words(rnd, 6000, 50)), row(0, base[0], "en", "s0"), row(305, "one\none\n\ntwo words\nTWO words\nend")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
