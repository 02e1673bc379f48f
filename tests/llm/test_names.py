"""Stages on tables whose extra columns have the names that stages use inside."""

import pytest
from pyspark.sql import functions as F

from threatlake.llm import decontamination, jaccard, lines, rules, simhash

NAMES = ["__key", "__drop", "__near", "__exact", "__spans", "key", "drop"]
STAGES = {
    "rules": rules.keep_good, "jaccard": jaccard.deduplicate, "simhash": simhash.deduplicate, "lines": lines.dedup_lines,
    "decontamination": lambda docs: decontamination.decontaminate(docs, docs.select(F.lit("i").alias("item_id"), F.lit("no such words here at all").alias("text")).limit(1)),
}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_names(spark, docs, stage):
    plain = docs.select("doc_id", "text")
    crowded = plain.withColumns({n: F.concat_ws("-", F.lit(n), "doc_id") for n in NAMES})
    want, got = STAGES[stage](plain), STAGES[stage](crowded)
    assert set(crowded.columns) <= set(got.columns)
    told = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    assert told(got) == told(want)
    for r in got.collect():
        assert all(r[n] == "-".join([n] + ([str(r["doc_id"])] if r["doc_id"] is not None else [])) for n in NAMES)
