"""Token ids of whole texts by a public tokenizer, and the histogram of encoded lengths.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
blank-separated chunks in order; where its rule for parts is the known one, a chunk is such a part.
Chunks repeat, texts don't: a task keeps the ids of the chunks it has met (a bounded number, the
latest) and asks the tokenizer only for new ones.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from threatlake.llm.common import arrow_map, texts
from threatlake.session import Scratch

TOKENIZER = "word_bpe_49k.json"
#: Chunks kept in each of two generations, and the longest chunk that is kept.
KEPT, LONGEST = 120_000, 64
#: Texts that a tokenizer must encode like their parts if chunks are to be encoded alone.
_PROBES = (("Word, and words!", ("word", ",", "and", "words", "!")), (" a\n\tGr\u00f6\u00dfe \u00c9t\u00e9.", ("a", "gr\u00f6\u00dfe", "\u00e9t\u00e9", ".")))
#: How the known tokenizer finds the parts of a text, after it has lower-cased it.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The same rule for texts of Latin-1 characters in lower case; a capital is in no part.
_LETTERS, _NUMBERS, _SPACES = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_CAPITALS = "A-Z\u00c0-\u00d6\u00d8-\u00de"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}{_CAPITALS}]+")
#: A mark that stands alone between a letter or digit and a blank: it is a part of its own either way.
_MARK = re.compile(r"[.,;:!?](?= |$)(?<=[^\W_].)")
#: Byte -> the character that stands for it in byte-level vocabularies: printable ones are their own.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [c for c in range(256) if c not in _PRINTABLE]
_BYTE_CHARS = {c: 256 + i for i, c in enumerate(_OTHERS)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _known_rule(tokenizer) -> bool:
    """Its steps before the merges are those that ``_PARTS`` follows."""
    made = [json.loads(step.__getstate__()) if step is not None else {} for step in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    cut, *after = made[1].get("pretokenizers") or [{}]
    return (
        made[0].get("normalizers") == _NORMALIZERS and cut.get("pattern") == {"Regex": _RULE} and cut.get("behavior") == "Removed" and cut.get("invert") is True
        and [(step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) for step in after] == [("ByteLevel", False, False)]
    )


class Encoder(dict):
    """chunk -> its ids as little-endian 32-bit bytes, for a tokenizer that lower-cases and drops white space.

    Texts of Latin-1 characters are lower-cased first and cut into parts by the tokenizer's own rule, if it
    is the known one; else single marks are parted from their words, so that the chunks met are mostly known.
    A new part, or chunk of letters, goes straight to the vocabulary's merges. Other chunks go through the
    whole tokenizer. A tokenizer of another kind gets whole texts.
    """

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        tokenizer = Tokenizer.from_file(path)
        self._encode, self._merge, self.old = tokenizer.encode, tokenizer.model.tokenize, {}
        self.by_chunk = all(self._whole(text) == b"".join(map(self._word, parts)) for text, parts in _PROBES)
        self.by_part = self.by_chunk and _known_rule(tokenizer)

    def _whole(self, text: str) -> bytes:
        return _packed(self._encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return b"".join([t.id.to_bytes(4, "little") for t in self._merge(word)])

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            plain = chunk.isalpha() and chunk.islower() and (chunk.isascii() or max(chunk) < "\u0100")
            part = plain or (self.by_part and _PARTS.fullmatch(chunk) and max(chunk) < "\u0100")
            ids = self._word(chunk) if part else self._whole(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """The ids of the text, 4 bytes each. Only blank, tab and line ends part chunks: the tokenizer
        drops these, while some further characters that Python calls blank are kept by it."""
        if not text:
            return b""
        if not self.by_chunk:
            return self._whole(text)
        latin = (text.isascii() or max(text) < "\u0100") and "<|" not in text
        get = self.__getitem__
        if latin and self.by_part:
            return b"".join(map(get, _PARTS.findall(text.lower())))
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        if latin:
            text = _MARK.sub(r" \g<0>", text.lower())
        return b"".join([get(chunk) for chunk in text.split(" ") if chunk])


@cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker. ``path`` None: the default file, found where the task runs."""
    return Encoder(path)


def encoded_lengths(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """id, length (bigint): the tokens of each text. A null or empty text has none."""

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(tokenizer).ids
        n = [len(ids(t)) >> 2 for t in step.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([step.column("id"), pa.array(n, pa.int64())], ["id", "length"])

    rows = texts(docs, id_col, text_col)
    return arrow_map(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, length bigint")


#: Lengths summed as one block before blocks are summed.
BLOCK = 256


def length_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Exact histogram of encoded lengths with its suffix sums, one row per length that occurs.

    length; n_docs; n_tokens; docs_below, tokens_below (shorter documents); docs_from, tokens_from
    (this length or more); truncated_total: tokens left if each document is cut at ``length``;
    quantile: share of documents of at most this length. Every row counts, repeated ones too; null and
    empty texts have length 0; an empty table gives no rows. Lengths are summed in blocks, then
    blocks (one row per 256 lengths), so no task sees all lengths.
    """
    with Scratch(docs.sparkSession) as work:
        counted = encoded_lengths(docs, id_col, text_col, tokenizer).groupBy("length").agg(F.count("*").alias("n_docs"))
        rows = work.keep(
            counted.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {BLOCK}").alias("block")),
            "lengths",
        )
        blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
        below = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        sides = work.keep(
            blocks.select(
                "block", F.coalesce(F.sum("block_docs").over(below), F.lit(0)).alias("docs0"),
                F.coalesce(F.sum("block_tokens").over(below), F.lit(0)).alias("tokens0"),
                F.sum("block_docs").over(whole).alias("docs"), F.sum("block_tokens").over(whole).alias("tokens"),
            ),
            "blocks",
        )
    inside = W.partitionBy("block").orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("n_docs", "n_tokens")}
    summed = rows.withColumns({"docs_in": sums["n_docs"], "tokens_in": sums["n_tokens"]}).join(sides, "block")
    below_docs, below_tokens = F.col("docs0") + F.col("docs_in"), F.col("tokens0") + F.col("tokens_in")
    return summed.select(
        "length", "n_docs", "n_tokens", below_docs.alias("docs_below"), below_tokens.alias("tokens_below"),
        (F.col("docs") - below_docs).alias("docs_from"), (F.col("tokens") - below_tokens).alias("tokens_from"),
        (below_tokens + F.col("length") * (F.col("docs") - below_docs)).alias("truncated_total"),
        ((below_docs + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def limit_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """``length_table`` asked for some context limits: docs_cut (longer documents), tokens_kept, tokens_lost."""
    asked = table.select("length", "n_docs", "n_tokens", F.explode(F.lit(sorted(set(limits)))).alias("limit"))
    kept = F.col("n_docs") * F.least("length", "limit")
    return asked.groupBy(F.col("limit").cast("bigint").alias("limit")).agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(kept).alias("tokens_kept"),
        F.sum(F.col("n_tokens") - kept).alias("tokens_lost"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """Least length that at least the share of documents don't exceed."""
    asked = table.select("length", "quantile", F.explode(F.lit([float(p) for p in sorted(set(shares))])).alias("share"))
    return asked.where("quantile >= share").groupBy("share").agg(F.min("length").alias("length"))
