import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from threatlake.llm import packing, tokens
from threatlake.llm.tokens import Encoder, encoded_lengths, length_table, limit_totals, quantiles

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = Encoder()


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check_texts(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ.,;:!?'\"-_ \n\t\r\x0b\x0c\x1c\x85  éÉßİΣςǅµª½²東é<|>0129&ü")), max_size=40))
def test_encoder_equals_the_tokenizer(text):
    check_texts(text)


@pytest.mark.parametrize("text", [
    "<|endoftext|> x <|startoftext|>", "<|EndOfText|>", "it's we'll 'tis ' s", "...wait.. a.b, c", "WORD, Word. word", "ΟΔΟΣ ΣΑΣ", "été café.",
    "x" * 300, "a​b", "tab\there\r\nthere", "½. ². _. a_.",
])
def test_encoder_special(text):
    check_texts(text)


def test_latin_texts_never_go_through_the_whole_tokenizer(monkeypatch):
    """Every pair of Latin-1 characters between letters: the parts are the tokenizer's own, found without it."""
    fresh, chars = Encoder(), [chr(c) for c in range(256)]
    assert fresh.by_part
    texts = ["x".join(f"a{a}{b}b " for b in chars if a + b != "<|") for a in chars]
    told = [ids(text) for text in texts]
    monkeypatch.setattr(Encoder, "_whole", lambda self, text: pytest.fail(text))
    assert [np.frombuffer(fresh.ids(text), "<u4").tolist() for text in texts] == told


def test_encoder_capitals_beyond_latin():
    check_texts("\u0100 A \u00c9D ## \u00d7 a#")


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    fresh = Encoder()
    for text in ["alpha beta gamma delta epsilon zeta eta", "alpha, zeta. theta iota kappa", "alpha beta"] * 3:
        assert np.frombuffer(fresh.ids(text), "<u4").tolist() == ids(text)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, text = Encoder(path), "Two words, \n and  more"
    assert not other.by_chunk
    assert np.frombuffer(other.ids(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def used(runs):
    """Sequence -> its (offset, length)."""
    out = defaultdict(list)
    for length, _, first, count, offset in runs:
        for s in range(first, first + count):
            out[s].append((offset, length))
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    runs = packing.plan(counts, 64, 16, 3)
    numbers = defaultdict(list)
    for length, number, _, count, _ in runs:
        numbers[length] += range(number, number + count)
    assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used(runs).values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k * n for k, n in counts.items())
    # at most one sequence is half empty: of two, the later one's first piece would have gone into the earlier
    assert len(used(runs)) <= 2 * total / 64 + 1 or not counts


def test_plan_is_tight_on_many_pieces():
    rnd = random.Random(3)
    counts = Counter(min(2048, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(20000))
    total = sum(k * n for k, n in counts.items())
    assert len(used(packing.plan(dict(counts)))) <= 1.003 * total / 2048


def test_nonnegative_fit_recovers_counts():
    a = np.array([[1, 0, 2.0], [0, 1, 1], [1, 1, 0]])
    x = packing.nonnegative_fit(a, a @ [3, 0, 5], np.ones(3), 5000)
    assert np.allclose(x, [3, 0, 5], atol=1e-3)


def test_pack(docs, corpus, empty):
    got = packing.pack(docs, capacity=256, keep_ids=True).collect()
    texts = Counter((r[0], tuple([*ids(r[1]), 0])) for r in corpus)
    want = Counter()
    for (i, t), n in texts.items():
        for p, at in enumerate(range(0, len(t), 256)):
            part = np.array(t[at : at + 256], "<u4").tobytes()
            want[(i, p, at, len(part) // 4, zlib.crc32(part), part)] += n
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty).collect() == []


def test_sequences(docs):
    packed = packing.pack(docs, capacity=512, keep_ids=True)
    whole = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert all(bytes(r.ids)[4 * s.offset :][: 4 * s.length] == whole[r.sequence_id, s.offset] for s in r.spans)


def test_length_table(docs, corpus, empty, spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 7)
    lengths = sorted(len(ids(r[1])) for r in corpus)
    assert sorted(r.length for r in encoded_lengths(docs).collect()) == lengths
    table = length_table(docs).cache()
    rows = {r.length: r for r in table.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for k, r in rows.items():
        below, there = [x for x in lengths if x < k], [x for x in lengths if x >= k]
        assert (r.n_docs, r.n_tokens) == (lengths.count(k), k * lengths.count(k))
        assert (r.docs_below, r.tokens_below, r.docs_from, r.tokens_from) == (len(below), sum(below), len(there), sum(there))
        assert r.truncated_total == sum(min(x, k) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    for r in limit_totals(table, [1, 50, 10**6]).collect():
        assert (r.docs_cut, r.tokens_kept) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
        assert r.tokens_kept + r.tokens_lost == sum(lengths)
    for r in quantiles(table, [0.5, 0.9, 1.0]).collect():
        assert r.length == min(k for k in lengths if sum(x <= k for x in lengths) >= r.share * len(lengths))
    assert length_table(empty).collect() == []
