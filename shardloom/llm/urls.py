"""URL filters: host and path rules first, then the ratio of two character language models, of accepted and of rejected URLs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words in a host that mark the rejected URLs to learn from where no table of labels is given.
REJECTED = ("spam", "casino", "pills", "bets", "ads-", "track", "adult", "porn", "xxx", "viagra", "loan")
#: Order of the models: characters of context at most. Symbols: letters, digits as one, . - / and any other.
ORDER, SYMBOLS = 3, 32
#: Score steps of the calibration's histogram, and the range that they cover.
STEPS, SPAN = 2000, 10.0


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. A url that is null or without ``://`` has both empty."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _codes(text: str) -> np.ndarray:
    """Symbols 0 to 31: 0 an end, 1 to 26 letters, 27 a digit, 28 a dot, 29 a hyphen, 30 a slash, 31 any other byte."""
    return _TABLE[np.frombuffer(text.encode(), np.uint8)]


_TABLE = np.full(256, 31, np.int64)
_TABLE[97:123] = np.arange(1, 27)
_TABLE[65:91] = np.arange(1, 27)
_TABLE[48:58] = 27
_TABLE[[46, 45, 47]] = [28, 29, 30]


def grams(text: str) -> np.ndarray:
    """A number of ORDER + 1 symbols for every symbol of a text and for its end; contexts begin with end symbols."""
    codes = np.concatenate([np.zeros(ORDER, np.int64), _codes(text), [0]])
    n = len(codes) - ORDER
    return sum(codes[k : k + n] << (5 * (ORDER - k)) for k in range(ORDER + 1))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of the counts of all SYMBOLS ** (ORDER + 1) grams: the log-probability of each gram's last symbol after the others.

    The orders from none to ORDER are interpolated by Witten-Bell: a context seen n times with t different symbols gives
    the weight t / (n + t) to the next shorter context; an unseen one all of it.
    """
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        c = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS).astype(float)
        n, t = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, SYMBOLS), (len(c) // max(1, p.size // SYMBOLS), 1)) if order else p[None, :]
        total = np.where(n + t > 0, n + t, 1)
        p = np.where(n > 0, (c + t * shorter) / total, shorter)
    return np.log(p).reshape(-1)


def _scored(ratio: np.ndarray, text: str) -> float:
    """Mean of the gram ratios over the symbols; 0 for an empty text."""
    return float(ratio[grams(text)].mean()) if text else 0.0


def labelled_urls(pages: DataFrame, url_col: str = "url", rejected: tuple[str, ...] = REJECTED, labels: DataFrame | None = None) -> DataFrame:
    """(text, bad, held) of the URLs to learn from: what follows ``://``; whether it is rejected; whether its host is kept from the counts.

    ``labels`` (url, rejected boolean): only its URLs are learnt from; of several labels of a URL rejected wins, null ones don't
    count. Without it a URL is rejected if its host contains one of the words ``rejected``. By a hash a fifth of the hosts is held out.
    """
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(url_col).alias("url"), host.alias("host"), _after_scheme(F.col(url_col)).alias("text")).where("host <> ''")
    if labels is None:
        bad = F.lit(False)
        for word in rejected:
            bad = bad | F.col("host").contains(word)
        rows = rows.withColumn("bad", bad)
    else:
        known = labels.where("rejected is not null and url is not null").groupBy("url").agg(F.bool_or("rejected").alias("bad"))
        rows = rows.join(known, "url")
    return rows.select("text", "bad", (F.pmod(F.xxhash64("host"), F.lit(5)) == 0).alias("held"))


def _counted(rows: DataFrame) -> np.ndarray:
    """Grams of accepted and of rejected texts (text, bad): counted in each task, summed by gram; 2 * 32 ** 4 sums at most, whatever the input."""

    def count(batches):
        sums = np.zeros((2, SYMBOLS ** (ORDER + 1)), np.int64)
        for part in batches:
            for text, b in zip(part["text"], part["bad"], strict=True):
                np.add.at(sums[int(b)], grams(text), 1)
        kind, gram = np.nonzero(sums)
        yield pd.DataFrame({"kind": kind.astype(np.int32), "gram": gram.astype(np.int32), "n": sums[kind, gram]})

    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    for row in rows.select("text", "bad").mapInPandas(count, "kind int, gram int, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["kind"], row["gram"]] = row["n"]
    return counts


def _ratio(counts: np.ndarray) -> np.ndarray:
    return (log_probabilities(counts[0]) - log_probabilities(counts[1])).astype(np.float32)


def least_error(hist: np.ndarray) -> float:
    """The score at which the share of accepted URLs below and of rejected URLs above are least together: the middle of the
    widest such stretch. ``hist``: accepted and rejected URLs by score step."""
    below = np.concatenate([[[0], [0]], hist.cumsum(axis=1)], axis=1) / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    error = below[0] + 1 - below[1]
    least = np.flatnonzero(error <= error.min() + 1e-12)
    runs = np.split(least, np.flatnonzero(np.diff(least) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 * (2 * SPAN / STEPS) - SPAN)


def fit_ratio(pages: DataFrame, url_col: str = "url", rejected: tuple[str, ...] = REJECTED, labels: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """(ratio, threshold): log-likelihood of accepted minus rejected by gram, and the score below which a URL is rejected.

    All labelled URLs count, see ``labelled_urls``. The threshold is calibrated on hosts that models for this purpose have not
    seen: it is where they make the least error on the held-out hosts; the models that score are then made of all counts. If
    the held-out hosts lack one of both labels, all URLs calibrate. Without rejected or without accepted URLs nothing is
    below the threshold.
    """
    rows = labelled_urls(pages, url_col, rejected, labels)
    held, seen = _counted(rows.where("held")), _counted(rows.where("not held"))
    if not (held + seen).sum(axis=1).all():
        return np.zeros(SYMBOLS ** (ORDER + 1), np.float32), -SPAN
    both = all(c.sum(axis=1).all() for c in (held, seen))
    score = score_udf(pages.sparkSession, _ratio(seen if both else held + seen))("text")
    step = F.floor((F.least(F.greatest(score, F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * (STEPS / (2 * SPAN)))
    hist = np.zeros((2, STEPS + 1))
    for row in (rows.where("held") if both else rows).groupBy(step.alias("step"), "bad").count().collect():  # 2 * (STEPS + 1) rows at most
        hist[int(row["bad"]), row["step"]] = row["count"]
    return _ratio(held + seen), least_error(hist)


def score_udf(spark, ratio: np.ndarray):
    """The length-normalised log-likelihood difference of a text; the table has 32 ** 4 numbers (4 MB)."""
    table = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([_scored(table.value, t or "") for t in text], dtype="float64")

    return score


def judge(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", rejected: tuple[str, ...] = REJECTED, labels: DataFrame | None = None
) -> DataFrame:
    """Per row of ``pages``: its id, host, path, rule, verdict ('allow' or 'block') and score.

    The verdict is the longest fitting rule's; without a rule, 'block' if the score of what follows ``://`` is below the
    calibrated threshold, see ``fit_ratio`` for ``rejected`` and ``labels``. A url that is null or has no ``://`` has empty host
    and path, no rule and score 0, and is allowed. Repeated rows and null ids are rows
    like any other, other columns don't matter whatever their names. URLs of any length are scored whole. No rules at all,
    no words and no labels leave all to the model, or allow all. An empty table gives no rows.
    """
    ratio, threshold = fit_ratio(pages, url_col, rejected, labels)
    host, path = host_and_path(F.col(url_col))
    text = F.coalesce(_after_scheme(F.col(url_col)), F.lit(""))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), score_udf(pages.sparkSession, ratio)(text).alias("score"))
    rows = rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("host") != "") & (F.col("score") < threshold), "block").otherwise("allow")
    return rows.select(id_col, "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", own).alias("verdict"), "score")
