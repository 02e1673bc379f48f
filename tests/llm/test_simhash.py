import random

import numpy as np
import pytest
import xxhash

from threatlake.llm import simhash
from threatlake.llm.components import components
from threatlake.session import Scratch


def slow_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in raw.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two THREE", "a b c d", "A b c d e É Ü x\x0by\x0cz", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 64)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('one two three four')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("one two three four", 42)


@pytest.mark.parametrize("n, blocks", [(2, 5), (5000, 6), (10**7, 7), (10**10, 9)])
def test_masks_cover_all_pairs(n, blocks):
    assert simhash.blocks_for(n, 4) == blocks
    masks = [m % (1 << 64) for m in simhash.block_masks(blocks, 4)]
    rnd = random.Random(n)
    for _ in range(300):
        flips = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & flips == 0 for m in masks)


def test_forest_connects_what_pairs_connect():
    rnd = np.random.default_rng(1)
    centers = rnd.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.array([int(rnd.choice(centers)) ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 5), replace=False)) for _ in range(150)], np.uint64))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4]
    nodes = range(len(fps))
    links = simhash.forest(fps, 4)
    assert slow_components(pairs, nodes) == slow_components(links, nodes) and len(links) < len(fps)


@pytest.mark.parametrize("chunk", [2, 8, 1024])
def test_links_of_crowded_keys(spark, chunk):
    rnd = random.Random(chunk)
    center = rnd.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    with Scratch(spark) as work:
        links = [(r.a, r.b) for r in simhash.near_links(nodes, work, chunk=chunk).collect()]
        found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), work).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 4]
    want = slow_components(pairs, signed)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 for a, b in links)
    assert groups({n: found.get(n, n) for n in signed}) == groups(want)


@pytest.mark.parametrize("shape", ["path", "star", "ring", "none"])
def test_components(spark, shape):
    n = 300
    links = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "ring": [(i, (i + 7) % n) for i in range(n)], "none": []}[shape]
    with Scratch(spark) as work:
        frame = spark.createDataFrame([*links, (5, 5), (None, 3)], "a bigint, b bigint")
        found = {r.node: r.root for r in components(frame, work).collect()}
    assert len(set(found.values())) == (1 if links else 0) and len(found) == len({x for p in links for x in p})


def test_near_duplicates(docs, corpus, empty):
    found = simhash.near_duplicates(docs).collect()
    texts = {(r[0], r[1]) for r in corpus}
    fps = {t: slow_fingerprint(t[1]) for t in texts}
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if bin([*fps.values()][a] ^ [*fps.values()][b]).count("1") <= 4]
    roots = slow_components(pairs, range(len(fps)))
    ids = [t[0] for t in fps]
    smallest = {r: min((ids[k] for k in roots if roots[k] == r and ids[k] is not None), default=None) for r in set(roots.values())}
    want = {(t[0], f): smallest[roots[k]] for k, (t, f) in enumerate(fps.items())}
    assert len(found) == len(corpus)
    assert {(r.id, r.fp % (1 << 64)): r.component for r in found} == want
    assert simhash.near_duplicates(empty).collect() == []


def test_deduplicate(docs, corpus, empty):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and ids.count(0) == 1 and 5 in ids and not set(range(100, 140)) & set(ids)
    classes = {r.component for r in simhash.near_duplicates(docs).collect()}
    assert set(ids) - {None} == classes - {None}
    assert simhash.deduplicate(empty).collect() == []
