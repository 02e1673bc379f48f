import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.llm import discriminant as qda, language

SF = "/root/testdata/sf0.1"


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_features_are_finite_and_spread():
    plain = "A plain sentence of some words, and then another one. " * 5
    rows = np.array([qda.features(t) for t in (None, "", " \n ", "x", plain, plain.upper() + "!!", "a | b | c | d " * 20, "Ü" * 5000)])
    assert rows.shape == (8, len(qda.NAMES)) and np.isfinite(rows).all()
    at = {n: i for i, n in enumerate(qda.NAMES)}
    assert rows[5][at["upper"]] > rows[4][at["upper"]] and rows[6][at["symbols"]] > rows[4][at["symbols"]]


def test_score_is_the_log_density_difference():
    rnd = np.random.default_rng(0)
    x = [rnd.normal(size=(400, 3)) @ np.diag([1, 2, 3]) + 5, rnd.normal(size=(900, 3)) * 0.7]
    model = qda.Discriminant.fit(np.array([400.0, 900]), np.array([k.sum(0) for k in x]), np.array([k.T @ k for k in x]), 0.1)
    every = np.vstack(x)
    center, scale = every.mean(0), every.std(0)
    level = []
    for k in x:
        z = (k - center) / scale
        cov = np.cov(z.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / 3 * np.eye(3)
        d = (every - center) / scale - z.mean(0)
        level.append(np.log(len(k) / 1300) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(np.clip(level[0] - level[1], -700, 700))))


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = qda.score_quality(docs, labels).cache()
    rows = found.select("id", "held_out", "score", "predicted").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc(r.id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = found.where("held_out").join(labels, F.col("id") == F.col("doc_id")).select("quality", "predicted").collect()
    good, bad = ([r.predicted for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.02
    # labels of held-out rows, language and source change nothing
    other = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    again = qda.score_quality(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)), other)
    assert {(r.id, round(r.score, 6)) for r in again.collect()} == {(r.id, round(r.score, 6)) for r in rows}


def test_quality_edges(spark, docs, corpus, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in qda.score_quality(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, 1), (3, None), (None, 0), (4, 7)], "doc_id bigint, quality int")
    assert {r.score for r in qda.score_quality(docs, ones).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 0)], "doc_id bigint, quality int")
    got = qda.score_quality(docs, both).collect()
    assert len(got) == len(corpus) and all(np.isfinite(r.score) for r in got)
    assert qda.score_quality(empty, both).collect() == []


def test_trigrams():
    codes, counts = language.trigrams("Ab, 7 aB")
    gap = lambda *p: p[0] << 42 | p[1] << 21 | p[2]
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {gap(0, 97, 98): 2, gap(97, 98, 0): 2, gap(98, 0, 97): 1}
    assert all(len(language.trigrams(t)[0]) == 0 for t in (None, "", "12 !?"))


def test_bundle_binds_permuted_letters(monkeypatch):
    space = language.Space(64, 3)
    text = "the cat sat on the mat"
    codes, counts = language.trigrams(text)
    want = np.zeros(64)
    for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
        a, b, d = c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF
        want += n * np.roll(space.letter(a), 2).astype(int) * np.roll(space.letter(b), 1) * space.letter(d)
    assert np.allclose(space.bundle(codes, counts), want)
    monkeypatch.setattr(language, "KEPT", 4)
    assert np.allclose(language.Space(64, 3).bundle(codes, counts), want)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), F.col("id") == F.col("doc_id")).collect()
    assert len(rows) == docs.count() and all(r.held_out == (crc(r.id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98
    lost = docs.withColumn("source", F.lit("q")).withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang")))
    assert {(r.id, r.lang_pred) for r in language.identify(lost).collect()} == {(r.id, r.lang_pred) for r in rows}


def test_language_edges(spark, docs, corpus, empty):
    got = language.identify(docs).collect()
    assert len(got) == len(corpus)
    text = {r[0]: r[1] for r in corpus}
    for r in got:
        blank = not any(c.isalpha() for c in text[r.id] or "") if r.id is not None else r.score == 0
        assert (r.lang_pred == "und") == bool(blank) and (r.lang_pred == "und") <= (r.score == 0)
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(empty).collect() == []


@pytest.mark.parametrize("text", ["日本語の文章", "\ud800 lone", "a" * 100_000])
def test_odd_texts(text):
    v = language.Space(32, 1).unit(text)
    assert v is not None and np.isclose(np.linalg.norm(v), 1)
