import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from threatlake.llm import catalog, runs


def brute(words):
    """Every stretch of every period, extended as far as it goes; the smallest period of each."""
    best = {}
    for q in range(1, len(words) // runs.POWER + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(runs.LEAST_WORDS, runs.POWER * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic(rnd):
    words = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randrange(50))]
    if rnd.random() < 0.5 and words:
        p, a = rnd.randrange(1, 6), rnd.randrange(len(words))
        words[a:] = [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words))]
    return words * rnd.randrange(1, 7) if rnd.random() < 0.3 else words


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_random_words(seed):
    rnd = random.Random(seed)
    documents = [periodic(rnd) for _ in range(400)]
    found = runs.runs_of(documents)
    assert found == [brute(d) for d in documents] and sum(map(len, found)) > 100


def test_suffix_order_and_prefixes():
    symbols = np.array([1, 2, 1, 2, 1, 2, 1, 2, 1, 9, 1, 2, 1, 2, 1, 10])
    order, levels = runs.suffixes(symbols)
    assert order.tolist() == sorted(range(16), key=lambda i: symbols[i:].tolist())
    lcp = runs.common_prefixes(order, levels)
    for j in range(1, 16):
        a, b, n = order[j - 1], order[j], 0
        while max(a, b) + n < 16 and symbols[a + n] == symbols[b + n]:
            n += 1
        assert lcp[j] == (n if n >= 4 else 0)


def test_long_and_nested():
    assert runs.runs_of([[b"a"] * 30_000]) == [[(0, 30_000, 1)]]
    inner = [b"a"] * 7 + [b"b"]
    assert runs.runs_of([inner * 5]) == [sorted([(0, 40, 8), *((8 * k, 7, 1) for k in range(5))], key=lambda r: (r[0], r[2]))]
    assert runs.runs_of([[], [b"a"], [b"a"] * 5, [b"a", b"b"] * 3, [b"a", b"b"] * 4]) == [[], [], [], [], [(0, 8, 2)]]


def test_frame(spark, docs, corpus, empty):
    rows = runs.find_runs(docs).collect()
    assert len(rows) == len(corpus)
    want = sorted(repr((r[0], len(w := (r[1] or "").encode().split()), brute(w), b" ".join(runs.collapse(w, brute(w))).decode())) for r in corpus if len(r[1] or "") < 9000)
    got = sorted(repr((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"])) for r in rows if r["n_words"] < 2000)
    assert got == want
    assert runs.find_runs(empty).collect() == []


def test_collapse_overlapping():
    words = b"x a a a a a a b a a a a a a b y".split()
    assert b" ".join(runs.collapse(words, runs.runs_of([words])[0])) == b"x a b a b y"


def test_query_by_hand(spark, tmp_path):
    texts = {i: " ".join(f"w{(i * k * k) % 11}" for k in range(i % 70)) for i in range(300)} | {300: None, 301: "", 302: "a a a a a a"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        words, h = (text or "").encode().split(), crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        listing = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = b" ".join(runs.collapse(words, found))
        milli = 1000 * best[1] // best[2] if found else None
        assert got[i] == (len(found), *best, milli, sha256(listing.encode()).hexdigest(), sha256(kept).hexdigest())
    assert sum(v[0] for v in got.values()) > 10
