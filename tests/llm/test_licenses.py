import random
import zlib
from collections import Counter

import pytest

from threatlake.llm import hilbert, licenses
from threatlake.llm.common import plain_words


def brute_base(text):
    w = [x.decode() for x in plain_words(text)]
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_label(text, template):
    """Whether some place of the text has enough of the template's words in place and its key phrases."""
    w, t = plain_words(text), plain_words(template.text)
    for i in range(len(w) - len(t) + 1):
        part = w[i : i + len(t)]
        if sum(a == b for a, b in zip(part, t, strict=True)) >= template.needed * len(t) - 1e-9:
            joined = b" " + b" ".join(part) + b" "
            if all(b" " + b" ".join(plain_words(k)) + b" " in joined for k in template.keys):
                return True
    return False


@pytest.fixture(scope="module")
def notices():
    rnd = random.Random(4)
    pool = sorted({w for t in (*licenses.BASE, *licenses.TEMPLATES) for w in t.text.split()})
    out = [None, "", "CC-BY all rights reserved", "cc by cc by cc by", "General  Public\nLicense!", "all rights reserved all rights", "by cc"]
    out += [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(60)]
    for t in licenses.TEMPLATES:
        for changes in range(4):
            w = t.text.split()
            for _ in range(changes):
                w[rnd.randrange(len(w))] = "other"
            out.append("Before: " + " ".join(w).title() + ". After")
    return out


def test_scan(spark, notices):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(notices)], "doc_id int, text string, score int").repartition(3)
    got = {r.id: r for r in licenses.summary(licenses.scan(df)).collect()}
    assert len(got) == len(notices)
    for i, t in enumerate(notices):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        own = {k.label for k in licenses.TEMPLATES if brute_label(t, k)}
        assert r.labels == ",".join(sorted(own | set(filter(None, r.base_labels.split(","))))), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_scan_edges(docs, corpus, empty):
    assert licenses.scan(docs).count() == len(corpus)
    assert licenses.scan(empty).collect() == []


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = spark.range(1 << dims * bits).selectExpr(*[f"cast((id >> {bits * i}) & {(1 << bits) - 1} as int) c{i}" for i in range(dims)])
    rows = cells.select("*", hilbert.curve_index([cells[f"c{i}"] for i in range(dims)], bits).alias("h")).collect()
    order = sorted(rows, key=lambda r: r.h)
    assert [r.h for r in order] == list(range(len(rows)))
    assert all(sum(abs(a - b) for a, b in zip(p[:-1], q[:-1], strict=True)) == 1 for p, q in zip(order, order[1:], strict=False))


def check_shards(rows, shards):
    n = Counter(r.shard for r in rows)
    full = [n.get(k, 0) for k in range(shards)]
    assert max(full) - min(full) <= 1 and set(n) <= set(range(shards))
    for k in n:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n[k]))
    assert [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.curve for r in rows)


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_shards(docs, corpus, shards):
    rows = hilbert.shard_documents(docs, shards=shards).collect()
    assert len(rows) == len(corpus)
    check_shards(rows, shards)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert Counter((r.id, r["size"], r.text_crc32) for r in rows) == want


def test_equal_rows_and_empty(spark, empty):
    same = spark.createDataFrame([(1, "t", "en", "s")] * 100, "doc_id int, text string, lang string, source string")
    check_shards(hilbert.shard_documents(same, shards=8).collect(), 8)
    assert hilbert.shard_documents(empty).collect() == []


def test_files_prune_on_every_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    made = hilbert.shard_documents(docs)
    spans = hilbert.manifest(made, ["meta_source", "meta_lang", "size"]).collect()
    assert len(spans) == 40 and sum(r.n_rows for r in spans) == docs.count()
    total = sum(r.n_rows for r in spans)
    read = lambda f: sum(r.n_rows for r in spans if f(r)) / total
    assert read(lambda r: r.min_meta_lang <= "fr" <= r.max_meta_lang) < 0.6
    assert read(lambda r: r.min_meta_source <= "src7" <= r.max_meta_source) < 0.5
    assert read(lambda r: r.max_size >= 20000) < 0.6


def test_plan_stays_in_the_jvm(docs, capsys):
    hilbert.shard_documents(docs).explain()
    assert "Python" not in capsys.readouterr().out
