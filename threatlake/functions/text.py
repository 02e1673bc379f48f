"""Lexical statistics of strings and domain names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of ``text``; 0.0 for empty or NULL."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))

    def term(total: Column, ch: Column) -> Column:
        share = (size - F.length(F.replace(text, ch, F.lit("")))) / size
        return total - share * F.log2(share)

    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), term)
    return F.when(size > 0, bits + F.lit(0.0)).otherwise(F.lit(0.0))


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams in order; empty array for shorter text."""
    slots = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(slots, lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def ngram_stats(text: Column, sizes: Iterable[int] = (2, 3, 4)) -> dict[str, Column]:
    stats: dict[str, Column] = {}
    for n in sizes:
        stats[f"ngram_{n}_total_count"] = F.greatest(F.coalesce(F.length(text), F.lit(0)) - (n - 1), F.lit(0))
        stats[f"ngram_{n}_unique_count"] = F.coalesce(F.size(F.array_distinct(ngrams(text, n))), F.lit(0))
    return stats


def domain_features(domain: Column) -> dict[str, Column]:
    """Character statistics over the whole lower-cased name; label = part before the first dot."""
    name = F.coalesce(F.lower(F.trim(domain)), F.lit(""))
    size = F.length(name)
    digits = F.regexp_count(name, F.lit("[0-9]"))
    vowels = F.regexp_count(name, F.lit("[aeiou]"))
    letters = F.regexp_count(name, F.lit("[a-z]"))
    distinct = F.size(F.filter(F.array_distinct(F.split(name, "")), lambda c: c != ""))
    return {
        "domain_length": size,
        "main_label_length": F.length(F.split_part(name, F.lit("."), F.lit(1))),
        "num_digits": digits,
        "digit_ratio": F.when(size > 0, F.round(digits / size, 4)).otherwise(F.lit(0.0)),
        "unique_char_ratio": F.when(size > 0, distinct / size).otherwise(F.lit(0.0)),
        "vowel_consonant_ratio": vowels / F.greatest(letters - vowels, F.lit(1)),
        "domain_entropy": entropy(name),
    }
