import random
from collections import defaultdict

import numpy as np
import pytest

from threatlake.llm import decontamination as dc
from threatlake.llm.common import plain_words
from threatlake.llm.fm_index import FMIndex, suffix_array


def brute(text, items, width=10):
    windows = defaultdict(set)
    for item, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add("" if item is None else str(item))
    w, hit, found = plain_words(text), set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            if (x := tuple(w[k : k + size])) in windows:
                found |= windows[x]
                hit |= set(range(k, k + size))
    return len(w), len(hit), sorted(found)


def test_suffix_array():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        parts = [rnd.integers(1, rnd.integers(2, 5), rnd.integers(0, 30)) for _ in range(6)]
        s = np.concatenate([np.r_[p, 0] for p in parts])
        keyed = [(tuple(s[i : i + list(s[i:]).index(0)]), i) for i in range(len(s))]
        assert suffix_array(s).tolist() == [i for _, i in sorted(keyed)]


def test_index_finds_and_locates():
    rnd = np.random.default_rng(1)
    parts = [rnd.integers(1, 6, 200) for _ in range(4)]
    s = np.concatenate([np.r_[p, 0] for p in parts])
    index = FMIndex(s, np.concatenate([np.arange(201)] * 4), sample=8)
    patterns = np.array([[1, 2, 3], [5, 5, 5], [0, 2, 4], [3, 0, 1]])
    lo, hi = index.find(patterns, np.array([3, 3, 2, 3]))
    for p, n, a, b in zip(patterns, [3, 3, 2, 3], lo, hi, strict=True):
        want = [i for i in range(len(s) - n + 1) if 0 not in p[3 - n :] and (s[i : i + n] == p[3 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_search(size):
    rnd = random.Random(size)
    for _ in range(15):
        pool = [f"w{i}" for i in range(rnd.choice([1, 2, 40]))]
        texts = [None, "", "!!", *[" ".join(rnd.choice(pool) for _ in range(rnd.randrange(150))) for _ in range(12)]]
        items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(15)))) for i in range(6)] + [("x", texts[4][5:90])]
        windows = dc.Windows.of([(str(i), plain_words(t)) for i, t in items], 10)
        assert [(n, sum(b - a for a, b in s), k) for n, s, k in dc.search(texts, windows, size)] == [brute(t, items) for t in texts]


def test_without_spans():
    text = "Head, one TWO-three é; tail é."
    assert dc.without_spans(text, [(1, 4)]) == "Head,  é; tail é."
    assert dc.without_spans(text, [(0, 7)]) == "."


@pytest.fixture(scope="module")
def items(spark, corpus):
    texts = [corpus[5][1], " ".join(corpus[104][1].split()[3:25]), "w1 w2", "", None, " ".join(corpus[116][1].split()[4000:4040]), "no such words at all in any of the texts here"]
    return spark.createDataFrame([*[(i, t, "k") for i, t in enumerate(texts)], (None, "w3 w4", "k"), (0, "w5 w6 w7", "k")], "item_id bigint, text string, doc_id string")


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(docs, corpus, items, empty, monkeypatch, block):
    monkeypatch.setattr(dc.blocks, "__defaults__", ("item_id", "text", 10, block))
    pairs = [(r.item_id, r.text) for r in items.collect() if r.text]
    got = dc.contamination(docs, items).collect()
    assert len(got) == len(corpus)
    want = sorted((str(r[0]), *map(str, brute(r[1], pairs))) for r in corpus)
    assert sorted((str(r.id), str(r.n_words), str(r.n_hit), str(list(r.items))) for r in got) == want
    assert dc.contamination(empty, items).collect() == []
    assert all(r.n_hit == 0 and r.items == [] for r in dc.contamination(docs, items.limit(0)).collect())


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontaminate(docs, corpus, items, monkeypatch, block):
    monkeypatch.setattr(dc.blocks, "__defaults__", ("item_id", "text", 10, block))
    pairs = [(r.item_id, r.text) for r in items.collect() if r.text]
    out = dc.decontaminate(docs, items)
    assert out.schema == docs.schema
    before, after = {}, {}
    for r in corpus:
        before.setdefault(r[0], []).append(r[1])
    for r in out.collect():
        after.setdefault(r.doc_id, []).append(r.text)
    assert {k: len(v) for k, v in before.items()} == {k: len(v) for k, v in after.items()}
    for i, texts in before.items():
        for t in texts:
            n, hit, _ = brute(t, pairs)
            if not hit:
                assert t in after[i]
        if len(texts) == 1 and block > 60:
            n, hit, _ = brute(texts[0], pairs)
            assert len(plain_words(after[i][0])) == n - hit


def test_decontaminate_searches_the_given_text_in_every_block(spark, monkeypatch):
    """A window of a later block overlaps a span of an earlier one; a cut joins words to a window of a later block."""
    w = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w), "a"), (2, "x1 x2 x3 x4 x5 " + " ".join(w[:20]) + " x6 x7 x8 x9 x10", "b"), (3, None, "c")], "doc_id int, text string, __spans string")
    parts = [" ".join(w[:20]), " ".join(w[15:26]), " ".join(f"x{i}" for i in range(1, 11)), " ".join(w[40:52])]
    for order in (parts, parts[::-1]):
        items = spark.createDataFrame(list(enumerate(order)), "item_id int, text string").coalesce(1)
        for block in (1 << 20, 60, 1):
            monkeypatch.setattr(dc.blocks, "__defaults__", ("item_id", "text", 10, block))
            out = dc.decontaminate(docs, items)
            assert out.schema == docs.schema
            got = {r.doc_id: r.text and plain_words(r.text) for r in out.collect()}
            assert got == {1: plain_words(" ".join(w[26:40] + w[52:])), 2: [b"x%d" % i for i in range(1, 11)], 3: None}
            n_hit = {r.id: r.n_hit for r in dc.contamination(docs, items).collect()}
            assert n_hit == {1: 60 - len(got[1]), 2: 20, 3: 0}
