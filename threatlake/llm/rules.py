"""Quality rules as weak supervision: rules vote in grades or abstain, EM weighs them, a posterior decides.

Statistics, votes and posterior are built-in column functions over whole texts; nothing leaves the JVM.
A rule calls a document good, doubtful or bad, or says nothing. A bad document has one kind of defect, which the rules
of that family may see while the others vote as on good documents. EM estimates the share of each kind and how often each
rule casts each vote with and without its defect, from the counts of vote patterns (at most 4 to the number of rules,
whatever the corpus), summed over all documents. So a doubtful vote that good documents often get costs little, and
several of one family add up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.llm.common import own
from threatlake.session import Scratch

#: Separators of words `[^\x20\x09-\x0D]+`, as a regular expression and as characters.
_GAP, _GAPS = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 8
#: Rule -> (statistic, side, bad beyond, doubtful beyond, good up to). Between the last two it abstains.
RULES = {
    "repetition": ("repeat_share", "above", 0.30, 0.10, 0.05),
    "symbols": ("symbol_share", "above", 0.20, 0.10, 0.02),
    "capitals": ("upper_share", "above", 0.50, 0.30, 0.15),
    "stutter": ("stutter_share", "above", 0.20, 0.10, 0.05),
    "same_lines": ("dup_line_share", "above", 0.50, 0.30, 0.10),
    "long_words": ("mean_word", "above", 14.0, 12.0, 10.0),
    "short_words": ("mean_word", "below", 2.0, 2.5, 3.0),
    "few_words": ("n_words", "below", 20.0, 30.0, 40.0),
    "vocabulary": ("distinct_share", "below", 0.08, 0.14, 0.20),
}
#: Votes, from worst to best.
BAD, DOUBTFUL, GOOD = 0, 1, 2
#: Kinds of defects and the rules that see them. Two classes without kinds would not do: rules that go together would be
#: taken for the truth, and a defect that only one rule sees for an error of that rule.
FAMILIES = {
    "repeating": ("repetition", "stutter", "vocabulary"), "lines": ("same_lines",), "symbols": ("symbols",),
    "capitals": ("capitals",), "words": ("long_words", "short_words"), "length": ("few_words",),
}
#: Shares of the three votes expected without and with a defect of the rule's family, and of good documents.
EXPECTED_WITHOUT, EXPECTED_WITH, USUAL_SHARE = (0.002, 0.028, 0.97), (0.4, 0.2, 0.4), 0.9
#: What they count for, as a share of the documents, so alike at every size. Of a family with one rule the votes alone
#: can't tell a defect from an error; there the votes expected without a defect decide, so they weigh most.
WITHOUT_WEIGHT, OTHER_WEIGHT = 0.1, 0.01
KEEP_FROM = 0.5


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the struct ``__stats``; a null text counts as an empty one.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier line), n_repeat_words (words in 8-word windows found twice or more in the text, the
    first included; windows are told apart by a 64-bit hash within the text), and the shares the
    rules look at.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    trimmed = F.trim(text, F.lit(_GAPS))
    words = F.when(trimmed != "", F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.withColumns({"__text": text, "__words": words, "__lines": lines})
    n = F.size("__words")
    window = F.arrays_zip(*[F.slice("__words", k, n - (WINDOW - 1)).alias(f"w{k}") for k in range(1, WINDOW + 1)])
    hashes = F.when(n >= WINDOW, F.transform(window, lambda w: F.xxhash64(w)))
    two = one.withColumn("__hashes", hashes)
    numbered = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    three = two.withColumn("__sorted", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(numbered)))
    m = F.size("__sorted")
    met = F.zip_with(
        F.slice("__sorted", 1, m - 1), F.slice("__sorted", 2, m - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(met, lambda x: x.isNotNull()))))
    empty = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        starts, empty, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )
    short, long = F.slice("__words", 1, n - 1), F.slice("__words", 2, n - 1)
    same_next = F.when(n > 1, F.aggregate(F.zip_with(short, long, lambda a, b: a == b), F.lit(0), lambda k, x: k + x.cast("int"))).otherwise(0)
    length = F.char_length("__text")
    without = lambda chars: length - F.char_length(F.translate("__text", chars, ""))
    four = three.withColumn("__counts", F.struct(
        n.cast("bigint").alias("n_words"), (length - without(_GAPS)).cast("bigint").alias("word_chars"),
        without(_SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("__sorted").isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.size("__lines").alias("n_lines"), F.size(F.array_distinct("__words")).alias("n_distinct"),
        same_next.alias("n_stutter"), without("!").alias("n_shout"),
        (length - F.char_length(F.regexp_replace("__text", "\\p{Lu}+", ""))).alias("n_upper"),
    ))
    c = lambda name: F.col(f"__counts.{name}")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    stats = F.struct(
        *[c(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        part(c("n_repeat_words"), c("n_words")).alias("repeat_share"), part(c("n_symbols"), c("n_words")).alias("symbol_share"),
        part(c("n_upper"), c("word_chars")).alias("upper_share"), part(c("n_shout"), c("n_words")).alias("shout_share"),
        part(c("n_stutter"), c("n_words")).alias("stutter_share"), part(c("n_dup_lines"), c("n_lines")).alias("dup_line_share"),
        part(c("word_chars"), c("n_words")).alias("mean_word"), part(c("n_distinct"), c("n_words")).alias("distinct_share"),
    )
    return four.withColumn("__stats", stats).drop("__text", "__words", "__lines", "__hashes", "__sorted", "__counts")


def base_failed(stats: str = "__stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


def votes(stats: str = "__stats") -> Column:
    """Struct of one vote per rule: 0 bad, 1 doubtful, 2 good, null abstains."""
    cells = []
    for rule, (statistic, side, bad, doubtful, good) in RULES.items():
        x = F.col(f"{stats}.{statistic}")
        worse, fine = (lambda bound: x > bound, x <= good) if side == "above" else (lambda bound: x < bound, x >= good)  # noqa: B023
        cells.append(F.when(worse(bad), BAD).when(worse(doubtful), DOUBTFUL).when(fine, GOOD).alias(rule))
    return F.struct(*cells)


@dataclass(frozen=True)
class Accuracies:
    """prior: share of good documents; defects[family]: of those with its defect; without[rule], with_[rule]: shares of the
    rule's bad, doubtful and good votes on documents without and with a defect of its family."""

    prior: float
    defects: dict[str, float]
    without: dict[str, tuple[float, ...]]
    with_: dict[str, tuple[float, ...]]

    def weight(self, rule: str, level: int) -> float:
        """Log ratio of a vote with the defect to without it."""
        return math.log(self.with_[rule][level] / self.without[rule][level])

    def posterior(self, vote: str) -> Column:
        """Probability of no defect: votes of other families cancel in the ratio of a defect to none."""
        against = F.lit(1.0)
        for family, rules in FAMILIES.items():
            odds = F.lit(math.log(self.defects[family] / self.prior))
            for rule in rules:
                v = F.col(f"{vote}.{rule}")
                levels = F.when(v == BAD, self.weight(rule, BAD)).when(v == DOUBTFUL, self.weight(rule, DOUBTFUL)).when(v == GOOD, self.weight(rule, GOOD))
                odds = odds + levels.otherwise(0.0)
            against = against + F.exp(odds)
        return 1 / against


def _mixed(counts: list[float], expected: tuple[float, ...], weight: float) -> tuple[float, ...]:
    """Shares of the counts with the expected ones mixed in as ``weight`` documents."""
    whole = sum(counts) + weight
    return tuple((c + weight * e) / whole for c, e in zip(counts, expected, strict=True))


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 200) -> Accuracies:
    """EM over counted vote patterns (votes in the order of ``RULES``). No pattern: what is expected.

    It starts from the expected shares, so from the belief that bad votes mean defects. Expectations weigh a share
    of the documents: twice the documents in the same proportions give the same estimates.
    """
    place = {rule: j for j, rule in enumerate(RULES)}
    usual = (USUAL_SHARE, *[(1 - USUAL_SHARE) / len(FAMILIES)] * len(FAMILIES))
    found = Accuracies(USUAL_SHARE, dict(zip(FAMILIES, usual[1:], strict=True)), dict.fromkeys(RULES, EXPECTED_WITHOUT), dict.fromkeys(RULES, EXPECTED_WITH))
    total = sum(n for _, n in patterns)
    last: list[list[float]] = []
    for _ in range(rounds if total else 0):
        beliefs = []  # per pattern: good, then the families
        for v, _ in patterns:
            odds = [1.0]
            for family, rules in FAMILIES.items():
                seen = sum(found.weight(r, v[place[r]]) for r in rules if v[place[r]] is not None)
                odds.append(math.exp(math.log(found.defects[family] / found.prior) + seen))
            beliefs.append([o / sum(odds) for o in odds])
        if last and max(abs(a - b) for x, y in zip(beliefs, last, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
        last = beliefs
        sizes = [sum(q[k] * n for q, (_, n) in zip(beliefs, patterns, strict=True)) for k in range(len(usual))]
        shares = _mixed(sizes, usual, OTHER_WEIGHT * total)
        without, with_ = {}, {}
        for k, rules in enumerate(FAMILIES.values(), 1):
            for rule in rules:
                cast = ([0.0] * 3, [0.0] * 3)
                for q, (v, n) in zip(beliefs, patterns, strict=True):
                    x = v[place[rule]]
                    if x is not None:
                        cast[0][x] += (1 - q[k]) * n
                        cast[1][x] += q[k] * n
                without[rule] = _mixed(cast[0], EXPECTED_WITHOUT, WITHOUT_WEIGHT * total)
                with_[rule] = _mixed(cast[1], EXPECTED_WITH, OTHER_WEIGHT * total)
        found = Accuracies(shares[0], dict(zip(FAMILIES, shares[1:], strict=True)), without, with_)
    return found


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (text hash), stats, votes, base_failed, posterior, kept; one row per row of ``docs``.

    Null, empty and blank texts have zero counts and fail the base rules. Equal texts get equal
    verdicts. An empty table gives no rows. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as work:
        only = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
        scored = statistics(only).select("id", F.xxhash64("text").alias("th"), F.col("__stats").alias("stats"))
        rows = work.keep(scored.withColumn("votes", votes("stats")), "votes")
    counted = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 4 ** len(RULES) rows
    found = estimate(sorted(((tuple(r["votes"]), r["n"]) for r in counted), key=str))
    posterior = found.posterior("votes")
    failed = base_failed("stats")
    return rows.withColumns({"base_failed": failed, "posterior": posterior}).withColumn("kept", ~failed & (posterior >= KEEP_FROM))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; their columns are unchanged."""
    name = own(docs, "__key")
    key = lambda id, th: F.concat_ws(":", id.isNull(), F.coalesce(id.cast("string"), F.lit("")), th).alias(name)
    out = judge(docs, id_col, text_col).where(~F.col("kept")).select(key(F.col("id"), F.col("th"))).distinct()
    marked = docs.withColumn(name, key(docs[id_col], F.xxhash64(docs[text_col].cast("string"))))
    return marked.join(out, name, "left_anti").drop(name)
