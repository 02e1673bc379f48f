import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threatlake.llm import rules

BLANKS = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    w = "".join(" " if c in BLANKS else c for c in text).split(" ")
    w = [x for x in w if x]
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    out = [None, "", "   ", " lead and trail \x0b\x0c\r", "no break space stays # 𝒳 %", "a\n\na\n a\nA\r\nA\r"]
    for n in (7, 8, 9, 30, 200):
        out += [" ".join(rnd.choice("ab") for _ in range(n)), " ".join(rnd.choice("abcdefghijkl") for _ in range(n)), "x " * n]
    passage = " ".join(f"p{i}" for i in range(12))
    return [*out, f"{passage} mid {passage}", f"{passage} {passage} {passage}", ("line of words #1\n" * 4) + "end", " ".join(map(str, range(20000)))]


def test_base_counts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r["__stats"] for r in rules.statistics(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(t), t


def kinds():
    """Good documents, then a class per defect: the rules that see it."""
    return [(), *rules.FAMILIES.values()]


def likelihoods(shares, without, with_, vote):
    """Probability of each kind together with the votes, every rule multiplied in."""
    out = []
    for share, seen in zip(shares, kinds(), strict=True):
        for rule, v in zip(rules.RULES, vote, strict=True):
            if v is not None:
                share *= (with_ if rule in seen else without)[rule][v]
        out.append(share)
    return out


def slow_posterior(found, vote):
    parts = likelihoods([found.prior, *found.defects.values()], found.without, found.with_, vote)
    return parts[0] / sum(parts)


def slow_em(documents, rounds):
    """EM document by document, by plain Bayes over the kinds."""
    n, k = len(documents), len(rules.FAMILIES)
    usual = [rules.USUAL_SHARE] + [(1 - rules.USUAL_SHARE) / k] * k
    shares, without, with_ = usual, dict.fromkeys(rules.RULES, rules.EXPECTED_WITHOUT), dict.fromkeys(rules.RULES, rules.EXPECTED_WITH)
    for _ in range(rounds):
        soft = []
        for d in documents:
            parts = likelihoods(shares, without, with_, d)
            soft.append([x / sum(parts) for x in parts])
        small, large = rules.OTHER_WEIGHT * n, rules.WITHOUT_WEIGHT * n
        shares = [(sum(q[i] for q in soft) + small * usual[i]) / (n + small) for i in range(k + 1)]
        fresh = {}, {}
        for j, rule in enumerate(rules.RULES):
            at = next(i for i, seen in enumerate(kinds()) if rule in seen)
            for there, weight, expected in ((0, large, rules.EXPECTED_WITHOUT), (1, small, rules.EXPECTED_WITH)):
                votes = [(q[at] if there else 1 - q[at], d[j]) for q, d in zip(soft, documents, strict=True) if d[j] is not None]
                total = sum(q for q, _ in votes) + weight
                fresh[there][rule] = [(sum(q for q, v in votes if v == x) + weight * expected[x]) / total for x in range(3)]
        without, with_ = fresh
    return shares, without, with_


def drawn(n, seed):
    """Documents with a few errors of one rule, and defects that one, two or three rules see."""
    rnd = random.Random(seed)
    names = list(rules.RULES)
    out = []
    for _ in range(n):
        vote = {r: None if rnd.random() < 0.04 else rules.GOOD for r in names}
        kind = rnd.random()
        if kind < 0.08:
            vote["symbols"] = rules.BAD
        elif kind < 0.12:
            vote |= {"repetition": rules.BAD, "stutter": rules.BAD if rnd.random() < 0.9 else rules.GOOD, "vocabulary": rules.BAD if rnd.random() < 0.9 else rules.GOOD}
        elif kind < 0.20:
            vote["repetition"] = rules.DOUBTFUL
        out.append(tuple(vote.values()))
    return out


def test_em_against_plain_em():
    documents = drawn(400, 2)
    found = rules.estimate(sorted(Counter(documents).items(), key=str), rounds=12)
    shares, without, with_ = slow_em(documents, 12)
    assert [found.prior, *found.defects.values()] == pytest.approx(shares)
    for rule in rules.RULES:
        assert found.without[rule] == pytest.approx(without[rule]) and found.with_[rule] == pytest.approx(with_[rule])


def test_posterior_decides():
    """A defect one rule sees is found; frequent doubts cost little; a bad vote counts less if its family saw nothing."""
    documents = drawn(5000, 3)
    counted = sorted(Counter(documents).items(), key=str)
    found = rules.estimate(counted)
    fine = dict.fromkeys(rules.RULES, rules.GOOD)
    at = lambda **v: slow_posterior(found, tuple((fine | v).values()))
    assert at() > 0.9 and at(symbols=rules.BAD) < 0.5 and at(repetition=rules.DOUBTFUL) > 0.5
    assert at(repetition=rules.BAD, stutter=rules.BAD) < 0.1 < at(repetition=rules.BAD)
    assert at(repetition=rules.DOUBTFUL, stutter=rules.DOUBTFUL, vocabulary=rules.DOUBTFUL) < 0.5
    larger = rules.estimate([(v, 1000 * n) for v, n in counted])
    assert larger.prior == pytest.approx(found.prior) and larger.with_["symbols"] == pytest.approx(found.with_["symbols"])
    assert rules.estimate([]).prior == rules.USUAL_SHARE


def test_judge(spark, docs, corpus, empty):
    found = rules.judge(docs).collect()
    assert len(found) == len(corpus)
    votes = [(tuple(r.votes), r.posterior) for r in found]
    weights = rules.estimate(sorted(Counter(v for v, _ in votes).items(), key=str))
    for r in found:
        assert r.posterior == pytest.approx(slow_posterior(weights, tuple(r.votes)))
        failed = r.stats.n_words < 20 or 100 * r.stats.n_repeat_words > 30 * r.stats.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= 0.5)
    assert rules.judge(empty).collect() == []


def test_keep_good(spark, docs, empty):
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = {(r.id, r.th) for r in rules.judge(docs).collect() if r.kept}
    rows = kept.withColumn("h", F.xxhash64("text")).collect()
    assert {(r.doc_id, r.h) for r in rows} == want and not [r for r in rows if r.text is None]
    assert rules.keep_good(empty).collect() == []


def test_plan_stays_in_the_jvm(docs, capsys):
    rules.judge(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


def test_junk_is_rejected_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, F.col("id") == F.col("doc_id"))
    counts = {(r.quality, r.kept): r["count"] for r in found.where("stats.n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert counts.get((0, True), 0) <= 0.02 * counts[0, False] and counts.get((1, False), 0) <= 0.01 * counts[1, True]
