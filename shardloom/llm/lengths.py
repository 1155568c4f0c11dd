"""Token counts: one exact histogram of encoded lengths answers totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's byte-level BPE parts a text into words; a fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in a range, for running sums in two steps.
RANGE = 1024


@lru_cache(1)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (int), the length of the whole text's encoding; a null or empty text has none.

    Special tokens' strings are ordinary text. Texts are encoded whole, however long. A column ``n_tokens`` of ``docs`` is
    replaced, other columns and repeated rows stay. An empty table gives no rows.
    """
    path = f"file://{vocabulary}" if vocabulary.startswith("/") else vocabulary
    content = docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0]
    ranks = docs.sparkSession.sparkContext.broadcast(bytes(content))

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        encode = _encoding(ranks.value).encode_ordinary
        return text.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return docs.withColumn("n_tokens", count(text_col))


def histogram(counted: DataFrame, by: str = "n_tokens") -> DataFrame:
    """One row per encoded length: n_tokens, n_docs, and suffix sums over all longer or equal lengths.

    For a context limit L equal to ``n_tokens``: ``docs_from`` and ``tokens_from`` count the documents of L tokens or
    more and their tokens; ``kept_tokens`` is the total when every document is cut at L; ``share_below`` is the share
    of documents shorter than L, so that the q-quantile is the largest length with share_below <= q.
    For limits between lengths see ``at_limit``. An empty table gives no rows. Sums run in two steps, over ranges of
    lengths and within them, so no task sees all lengths; the ranges are as many as the longest document's tokens / 1024.
    """
    n = F.col(by).cast("long")
    counts = cut(counted.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))
    counts = counts.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("toks").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("toks").over(whole).alias("all_tokens"),
    )
    own = Window.partitionBy("range").orderBy(F.desc("n_tokens"))
    rows = counts.withColumn("docs_own", F.sum("n_docs").over(own)).withColumn("tokens_own", F.sum("tokens").over(own)).join(ranges, "range")
    docs_from, tokens_from = F.col("docs_own") + F.col("docs_later"), F.col("tokens_own") + F.col("tokens_later")
    return rows.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("all_docs") - docs_from) / F.col("all_docs")).alias("share_below"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row: total tokens when every document is cut at ``limit``, and documents and tokens cut.

    Looked up in the suffix sums: the row of the least length over the limit has the documents and tokens that are cut, the
    row of the least length of all has all tokens.
    """
    sums = F.struct("n_tokens", "docs_from", "tokens_from")
    row = hist.agg(F.min(sums)["tokens_from"].alias("total"), F.min(F.when(F.col("n_tokens") > limit, sums)).alias("over"))
    cut_docs = F.coalesce("over.docs_from", F.lit(0))
    lost = F.coalesce("over.tokens_from", F.lit(0)) - cut_docs * limit
    return row.select((F.coalesce("total", F.lit(0)) - lost).alias("kept_tokens"), cut_docs.alias("cut_docs"), lost.alias("cut_tokens"))


def quantile(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the largest length of which at most ``share`` of the documents are shorter. No documents give null."""
    rows = [F.max(F.when(F.col("share_below") <= q, F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(shares)]
    out = hist.agg(*rows)
    return out.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(shares)])).alias("r")).select("r.*")
