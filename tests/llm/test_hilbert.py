from threatlake.llm import hilbert


def test_long_sources_that_share_a_prefix_are_apart(spark):
    """Texts are placed by the whole value, so each shard holds few of the sources."""
    rows = [(i, f"text {i * 7919 % 640}", f"https://a.example/source-{i % 32:02d}", "en") for i in range(640)] + [(900, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string").repartition(3)
    cells = hilbert.quantised(docs, ["source"])[0].select("source", "__cell0").distinct().collect()
    assert sorted((r.source or "", r["__cell0"]) for r in cells) == [("", 0), *((f"https://a.example/source-{i:02d}", i) for i in range(32))]
    out = hilbert.shard_documents(docs, shards=8).collect()
    assert len(out) == len(rows) and max(sum(r.shard == s for r in out) for s in range(8)) - min(sum(r.shard == s for r in out) for s in range(8)) <= 1
    assert max(len({r.meta_source for r in out if r.shard == s}) for s in range(8)) < 32
