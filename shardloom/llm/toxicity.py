"""Toxicity: a classifier that is penalised for scoring labelled sentences differently when identity terms are swapped."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import cut

#: Terms that name groups; a sentence's score should not depend on which of them it has.
IDENTITY = (
    "asian", "black", "blind", "catholic", "christian", "deaf", "disabled", "female", "gay", "hispanic", "hindu", "immigrant", "immigrants",
    "jewish", "jews", "latino", "lesbian", "male", "men", "muslim", "muslims", "old", "refugees", "trans", "transgender", "white", "women", "young",
)
#: Parameters of the training. Labelled rows to learn from at most (a sample by a hash of the id), features at most (those of the
#: largest z), documents of the sample that a feature must be in, its least z, and lengths of word beginnings.
SAMPLE, FEATURES, LEAST, LEAST_Z, BEGINNINGS = 20_000, 4096, 5, 3.5, (4, 5, 6)
#: Predicted toxic from this score on.
THRESHOLD = 0.7
RIDGE, SWAP, ROUNDS, ALARM = 1e-4, 1.0, 600, 3.0
LETTERS = re.compile(r"[^\W\d_]+")
WORDS = r"\p{L}+"


def features(text: str | None, known: dict[str, int], begins: frozenset[str]) -> set[int]:
    """Numbers of the known words (as ``word$``) and word beginnings in the whole text, lower-cased."""
    found = {w for w in LETTERS.findall((text or "").lower()) if w[: BEGINNINGS[0]] in begins}
    out = {known[k] for w in found if (k := w + "$") in known}
    return out | {known[k] for w in found for n in BEGINNINGS if len(w) >= n and (k := w[:n]) in known}


def swaps(text: str, terms: tuple[str, ...] = IDENTITY) -> list[str]:
    """The text with its identity terms replaced by the next ones of the list, and by those after half of it; none without such terms."""
    place = {t: i for i, t in enumerate(terms)}
    if not any(w in place for w in LETTERS.findall(text.lower())):
        return []
    other = lambda by: LETTERS.sub(lambda m: terms[(place[m[0].lower()] + by) % len(terms)] if m[0].lower() in place else m[0], text)
    return [other(1), other(len(terms) // 2)]


def line_swaps(text: str, terms: tuple[str, ...], known: dict[str, int], begins: frozenset[str]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Of every line and each of its swaps: the features that only the line has, and those that only the swap has."""
    out = []
    for line in text.split("\n"):
        if others := swaps(line, terms):
            own = features(line, known, begins)
            out += [(tuple(sorted(own - o)), tuple(sorted(o - own))) for o in (features(x, known, begins) for x in others)]
    return out


def boundary(odds: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which on to call a text toxic: the share of missed toxic texts and ALARM times that of false alarms
    sum to least, and the boundary is the middle of the widest such gap."""
    values, at = np.unique(odds, return_inverse=True)
    missed = np.concatenate(([0], np.cumsum(np.bincount(at, y)) / y.sum()))
    alarms = 1 - np.concatenate(([0], np.cumsum(np.bincount(at, 1 - y)) / (1 - y).sum()))
    error, edges = missed + ALARM * alarms, np.concatenate(([values[0] - 1], values, [values[-1] + 1]))
    k = int(np.where(error <= error.min() + 1e-9, edges[1:] - edges[:-1], -1).argmax())
    return float((edges[k] + edges[k + 1]) / 2)


class Classifier:
    """Logistic regression over the presence of words and word beginnings."""

    def __init__(self, names: list[str]) -> None:
        self.known = {w: i for i, w in enumerate(names)}
        self.begins = frozenset(w[: BEGINNINGS[0]].rstrip("$") for w in names)
        self.weights, self.bias = np.zeros(len(names)), 0.0

    def rows(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs."""
        found = [sorted(features(t, self.known, self.begins)) for t in texts]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([i for f in found for i in f], np.int64)

    def fit(self, texts: list[str], labels, pairs: list[tuple[str, str]]) -> Classifier:
        """Gradient steps on the mean log-loss, a ridge, and the mean squared difference of the log-odds (of which the score is the
        logistic function, so that equal log-odds are equal scores) over ``pairs`` of a sentence and its swap."""
        return self.fit_rows(*self.rows(texts), np.asarray(labels, float), self.rows([a for a, _ in pairs]), self.rows([b for _, b in pairs]), np.ones(len(pairs)))

    def fit_rows(self, at, feature, y, left, right, times) -> Classifier:
        """``times``: how often each pair counts."""
        n, k, n_pairs = max(1, len(y)), len(self.weights), len(times)
        share = min(max(float(y.mean()) if len(y) else 0.5, 1 / (n + 2)), 1 - 1 / (n + 2))
        self.bias = float(np.log(share / (1 - share)))
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        for step in range(1, ROUNDS + 1 if len(y) else 1):
            p = 1 / (1 + np.exp(-(np.bincount(at, self.weights[feature], len(y)) + self.bias)))
            grad = np.bincount(feature, (p - y)[at], k) / n + RIDGE * self.weights
            if n_pairs:
                gap = np.bincount(left[0], self.weights[left[1]], n_pairs) - np.bincount(right[0], self.weights[right[1]], n_pairs)
                gap *= times
                grad += 2 * SWAP / times.sum() * (np.bincount(left[1], gap[left[0]], k) - np.bincount(right[1], gap[right[0]], k))
            grad = np.append(grad, (p - y).mean())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.weights, self.bias = self.weights - move[:-1], self.bias - float(move[-1])
        if 0 < y.sum() < len(y):
            self.bias += math.log(THRESHOLD / (1 - THRESHOLD)) - boundary(np.bincount(at, self.weights[feature], len(y)) + self.bias, y)
        return self

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[i] for i in sorted(features(text, self.known, self.begins)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, total)))))


def train(labelled: DataFrame, terms: tuple[str, ...] = IDENTITY, sample: int = SAMPLE) -> Classifier:
    """A classifier from rows ``(doc_id, text, toxic)``; rows without a label or text don't count.

    Of n > ``sample`` rows those are taken whose hash of doc_id is in the lowest sample / n of hashes. The features are
    the FEATURES words and word beginnings that tell the labels apart best, by the z of the log-odds, which is LEAST_Z or more, counted on the
    executors; what comes to the driver is bounded by SAMPLE and FEATURES. Sentences are all lines of the sampled texts.
    """
    rows = labelled.where("text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = cut(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))
    beginning = lambda n: F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))
    heads = [beginning(n) for n in BEGINNINGS]
    every = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit("$"))), *heads))
    counts = rows.select("toxic", F.explode(every).alias("name")).groupBy("name").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(n + 0.5) - F.col(c) + 0.5))
    z = F.abs(odds("bad", bad) - odds("good", good)) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = counts.where((F.col("bad") + F.col("good") >= LEAST) & (z >= LEAST_Z)).orderBy(F.desc(F.round(z, 9)), "name").limit(FEATURES).select("name")
    names = sorted({r["name"] for r in best.collect()} | {t + "$" for t in terms})
    model = Classifier(names)
    shared = rows.sparkSession.sparkContext.broadcast((model.known, model.begins))

    def featured(batches):
        known, begins = shared.value
        for part in batches:
            yield pd.DataFrame({"toxic": part["toxic"], "own": [sorted(features(t, known, begins)) for t in part["text"]]})

    def swapped(batches):
        known, begins = shared.value
        for part in batches:
            found = Counter(swap for t in part["text"] for swap in line_swaps(t, terms, known, begins))
            if found:
                yield pd.DataFrame({"left": [list(a) for a, _ in found], "right": [list(b) for _, b in found], "n": list(found.values())})

    got = rows.select("text", "toxic").mapInPandas(featured, "toxic int, own array<int>").collect()  # SAMPLE rows of features
    # lines whose swaps change the same features are one row: what comes to the driver doesn't grow with the texts' length
    pairs = rows.select("text").mapInPandas(swapped, "left array<int>, right array<int>, n long").groupBy("left", "right").agg(F.sum("n").alias("n")).collect()
    pairs.sort(key=lambda r: (r["left"], r["right"]))
    flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64))
    at, feature = flat([r["own"] for r in got])
    left, right = flat([r["left"] for r in pairs]), flat([r["right"] for r in pairs])
    return model.fit_rows(at, feature, np.array([r["toxic"] for r in got], float), left, right, np.array([r["n"] for r in pairs], float))


def score_udf(spark, model: Classifier):
    """Score of a whole text; the model has FEATURES and IDENTITY terms at most."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        own = shared.value.score
        return pd.Series([own(t) for t in text], dtype="float64")

    return score


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _model(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Of the labels of a document those that are 0 or 1 count; if both occur, 1."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return train(docs.select("doc_id", "text").where(~held_out("doc_id")).join(known, "doc_id"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on).

    Learns from the labels of documents that are not held out, see ``_model``. A null text scores like an empty one. Without
    usable labels every score is 0.5. Repeated rows and null ids are scored like any other, texts are scored whole however
    long, and other columns of ``docs`` don't matter whatever their names. An empty table gives no rows.
    """
    model = _model(docs, labels)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), score_udf(docs.sparkSession, model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with their columns, whatever their names; nulls, repeated rows and empty
    tables as in ``toxicity``."""
    model = _model(docs, labels)
    return docs.where(score_udf(docs.sparkSession, model)("text") < THRESHOLD)
