import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from threatlake.llm import catalog, lines, rules, simhash
from threatlake.llm.common import plain_words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    value = lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    shape = lambda df: sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shape(got) == shape(want)


def test_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()


COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op6_hilbert_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op12_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op13_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert COLUMNS[name].items() <= dict(entry.queries()[name](spark, SF).dtypes).items()


def test_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        made.append(docs.collect())
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good, cut, near, clean, packed = made
    assert all(list(m[0].asDict()) == columns for m in made[:-1])

    kept = {r.id for r in rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    assert {r.doc_id for r in good} == kept and {r.doc_id: r for r in good} == {r.doc_id: r for r in given if r.doc_id in kept}

    # line dedup: no line is left that equals an earlier one, and only such and near ones are gone
    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        for n, line in enumerate(r.text.split("\n")):
            if w := tuple(lines.line_words(line)):
                first.setdefault(w, (r.doc_id, n))
    near_lines = {w for w in first if len(w) >= 8 and any(
        len(v) >= 8 and first[v] < first[w] and abs(len(v) - len(w)) <= 1 and lines.within_one_edit(list(v), list(w)) for v in first if v != w)}
    want = {}
    for r in good:
        left = [x for n, x in enumerate(r.text.split("\n")) if not (w := tuple(lines.line_words(x))) or (first[w] == (r.doc_id, n) and w not in near_lines)]
        if "".join(left).strip(" \t\n\x0b\x0c\r"):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)

    # near dedup: the smallest id of each component
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in cut}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in near) == [i for i in ids if find(i) == i]
    assert {r.doc_id: r.text for r in near}.items() <= want.items()

    # decontamination: hit words are gone, other texts unchanged
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    left = {r.doc_id: r.text for r in clean}
    hits = 0
    for r in near:
        w = plain_words(r.text)
        hit = {k + i for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for i in range(n)}
        hits += bool(hit)
        if not hit:
            assert left[r.doc_id] == r.text
        elif r.doc_id in left:
            assert plain_words(left[r.doc_id]) == [x for i, x in enumerate(w) if i not in hit]
    assert hits

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got, places = Counter(), defaultdict(list)
    for r in packed:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == lengths
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_edges(spark, docs, empty):
    for rows in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= 0
