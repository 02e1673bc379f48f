import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from threatlake.llm import toxicity

SF = "/root/testdata/sf0.01"
BAD = ["grubbel", "snorft", "zwickel"]


def sample(n, seed=3):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(rnd.randrange(1, 60))]
        label = int(rnd.random() < 0.3)
        if label:
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(BAD))
        docs.append((i, " ".join(words), "y", 1.0))
        labels.append((i, label))
    return docs, labels


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = sample(400)
    rows = [*docs, (1000, None, "y", 1.0), (1001, "", "y", 1.0), (1002, " \n", "y", 1.0), (None, "snorft snorft", "y", 1.0), (1003, "Grubbel " + "abc def " * 20_000, "y", 1.0), (0, docs[0][1], "y", 1.0)]
    known = [*labels, (7, None), (8, 5), (None, 1), (99999, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, label string, score double").repartition(3)
    return docs, dict(labels), frame, spark.createDataFrame(known, "doc_id bigint, toxic int")


def test_grams_by_hand():
    texts = ["Ab  c\tD", None, "", "x", "Ünï ab"]
    for n, (h, doc) in zip(toxicity.GRAMS, toxicity.grams(texts), strict=True):
        want = [(i, t[k : k + n]) for i, t in enumerate(map(toxicity.plain, texts)) for k in range(len(t) - n + 1)]
        assert doc.tolist() == [i for i, _ in want]
        value = {}
        for (_, gram), v in zip(want, h.tolist(), strict=True):
            assert value.setdefault(gram, v) == v and 0 <= v < 1 << toxicity.BITS


def test_counts_and_ratios_by_hand(spark):
    rows = [("abc abc", 1), ("abcd", 1), ("xyz", 0), ("abc", 0), ("", 0), (None, 1)]
    found = {r["feature"]: (r["n0"], r["n1"]) for r in toxicity.document_counts(spark.createDataFrame(rows, "text string, label int").repartition(3)).collect()}
    want = {0: Counter(), 1: Counter()}
    for text, label in rows:
        want[label].update({int(v) for h, _ in toxicity.grams([text]) for v in h})
    assert found.pop(-1) == (3, 3)
    assert found == {f: (want[0][f], want[1][f]) for f in want[0] | want[1]}
    ratio = toxicity.log_count_ratios(np.array([0, 2]), np.array([3, 1]), 3, 3)
    assert ratio == pytest.approx([math.log(4 / 5) - math.log(1 / 5), math.log(2 / 5) - math.log(3 / 5)])


def test_held_out_rows(made):
    docs, labels, frame, known = made
    rows = toxicity.score_toxicity(frame, known).collect()
    assert len(rows) == 406
    text = {d[0]: d[1] for d in docs}
    for r in rows:
        assert r["held_out"] == (r["id"] is not None and crc32(str(r["id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    away = [r for r in rows if r["held_out"] and r["id"] in text]
    assert sum(r["predicted"] == labels[r["id"]] for r in away) >= 0.97 * len(away)
    by_id = {r["id"]: r for r in rows}
    assert by_id[1000]["score"] == by_id[1001]["score"] == by_id[1002]["score"] < 0.5
    assert by_id[None]["predicted"] == by_id[1003]["predicted"] == 1


def test_model_by_brute_force(spark, made):
    """Every score is the logistic of the summed weights of the distinct n-grams of the whole text."""
    docs, labels, frame, known = made
    labelled = spark.createDataFrame([(d[1], labels[d[0]]) for d in docs if crc32(str(d[0]).encode()) % 5], "text string, label int")
    model = toxicity.fit(labelled)
    texts = [d[1] for d in docs] + [None, ""]
    for text, score in zip(texts, model.score(texts), strict=True):
        held = {int(v) for h, _ in toxicity.grams([text]) for v in h}
        assert score == pytest.approx(1 / (1 + math.exp(-(model.intercept + sum(model.weights[v] for v in held)))))
    got = {r["id"]: r["score"] for r in toxicity.score_toxicity(frame, known).collect() if r["id"] and r["id"] < 400}
    assert got == pytest.approx({d[0]: s for d, s in zip(docs, model.score(texts), strict=False) if d[0]}, abs=1e-3)


def test_bounded_training_rows(spark, made):
    _, _, frame, known = made
    few = toxicity.score_toxicity(frame, known, train_rows=3).collect()
    assert len(few) == 406 and len({r["score"] for r in few}) == 1  # three rows prove no feature


def test_labels_of_one_kind_or_none(spark, made, empty):
    _, _, frame, known = made
    assert toxicity.score_toxicity(empty, known).collect() == []
    assert {r["score"] for r in toxicity.score_toxicity(frame, known.limit(0)).collect()} == {0.5}
    clean = toxicity.score_toxicity(frame, known.where("toxic = 0")).collect()
    assert {r["predicted"] for r in clean} == {0} and len({r["score"] for r in clean}) == 1


def test_given_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.score_toxicity(docs, labels).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) >= 0.97 * len(found)
    bad = [r for r in found if r["toxic"] == 1]
    assert sum(r["predicted"] for r in bad) >= 0.7 * len(bad)
