"""Quality by weak supervision, with DataFrame operations only.

Rules over statistics of the whole text vote that a document is good, vote that it is bad, or abstain.
Expectation-maximisation over the counts of vote patterns estimates how often each rule votes which way for good and
for bad documents; the posterior probability of being good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import WORD, bind, cut

#: (name, statistic, good if at most, bad if over); between the two the rule abstains.
RULES = (
    ("repeats", "n_repeat_words / n_words", 0.05, 0.18),
    ("symbols", "n_symbols / n_words", 0.05, 0.30),
    ("marked_words", "n_marked_words / n_words", 0.05, 0.20),
    ("marked_lines", "n_marked_lines / n_lines", 0.25, 0.75),
    ("capitals", "n_upper / n_letters", 0.25, 0.60),
    ("shouts", "n_shouts / n_words", 0.10, 0.50),
    ("lines", "n_dup_lines / n_lines", 0.10, 0.50),
    ("long_words", "word_chars / n_words", 12.0, 20.0),
    ("short_words", "n_words / word_chars", 0.34, 0.50),
    ("no_sentences", "n_words / greatest(n_stops, 1)", 60.0, 400.0),
)
ROUNDS = 30
#: First guesses: share of good documents, P(votes bad | good) and P(votes bad | bad) where a rule votes, and for which share of the documents the guesses count.
GOOD, FALSE_ALARM, HIT, PSEUDO = 0.9, 0.01, 0.3, 0.1


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the array; linear but for one sort.

    Windows are compared by their XXH64 (64 bits).
    """
    count = lambda w: F.greatest(F.size(w) - (width - 1), F.lit(0))
    hashes = lambda w: F.transform(F.slice(w, F.lit(1), count(w)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bind(by_hash, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return bind(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, x: a + x))

    return bind(words, lambda w: bind(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and the counts that the rules use, over the whole text; a null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = {
        "n_words": F.size("words"),
        "word_chars": less(" \t\n\x0b\x0c\r") * -1 + F.length(text),
        "n_symbols": less("#*$%&|<>"),
        "n_dup_lines": bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_lines": F.size(lines),
        "n_marked_words": F.size(F.filter("words", lambda w: w.rlike("[#*$%&|<>]"))),
        "n_marked_lines": F.size(F.filter(lines, lambda x: x.rlike("[#*$%&|<>]"))),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_shouts": less("!"),
        "n_stops": less(".?!:;"),
    }
    rows = docs.select("doc_id", "text", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    return rows.select("doc_id", *[c.cast("long").alias(k) for k, c in out.items()])


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains."""
    out = {}
    for name, expression, good, bad in RULES:
        top, _, bottom = expression.partition(" / ")
        value = F.try_divide(F.expr(top), F.expr(bottom))
        out[name] = F.when(value > bad, -1).when(value <= good, 1).otherwise(0)
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and, per rule, P(votes bad | good, votes) and P(votes bad | bad, votes), by EM.

    Abstaining says nothing. ``patterns``: (votes, documents); there are 3 ** len(RULES) at most, whatever the corpus.
    The first guesses stay in the sums with the weight of PSEUDO of all documents; without documents they are the result.
    """
    first = (FALSE_ALARM, HIT)
    share, rates, weight = GOOD, [first for _ in RULES], PSEUDO * sum(n for _, n in patterns)
    for _ in range(ROUNDS if patterns else 0):
        bad = [[weight * p for p in first] for _ in RULES]
        voted = [[weight, weight] for _ in RULES]
        good = total = 0.0
        for pattern, n in patterns:
            p = posterior(pattern, share, rates)
            good, total = good + n * p, total + n
            for v, b, of in zip(pattern, bad, voted, strict=True):
                for k, m in enumerate((n * p, n * (1 - p)) if v else ()):
                    b[k] += m * (v < 0)
                    of[k] += m
        share = (good + weight * GOOD) / (total + weight)
        rates = [(b[0] / of[0], b[1] / of[1]) for b, of in zip(bad, voted, strict=True)]
    return share, rates


def evidence(rate: tuple[float, float]) -> dict[int, float]:
    """What a vote adds to the log-odds of being good."""
    return {-1: math.log(rate[0] / rate[1]), 0: 0.0, 1: math.log((1 - rate[0]) / (1 - rate[1]))}


def posterior(pattern: tuple[int, ...], share: float, rates: list[tuple[float, float]]) -> float:
    """Probability of being good given the votes."""
    odds = math.log(share / (1 - share)) + sum(evidence(r)[v] for r, v in zip(rates, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ``quality`` (the posterior probability of being good) and kept.

    base_failed: under 10 words, or over 20 % of the words in repeated windows. kept: not base_failed, and quality >=
    0.5. Texts that are null or empty fail the base. Repeated rows, null ids and any number of equal texts are rows
    like any other. An empty table gives no rows.
    """
    rows = cut(statistics(docs).withColumns(votes()))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    names = [r[0] for r in RULES]
    counted = rows.groupBy(*names).count().collect()  # 3 ** len(RULES) rows at most
    share, rates = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for name, rate in zip(names, rates, strict=True):
        step = evidence(rate)
        odds = odds + F.when(F.col(name) == 1, step[1]).when(F.col(name) == -1, step[-1]).otherwise(step[0])
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("quality") >= 0.5)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", kept.alias("kept"))
