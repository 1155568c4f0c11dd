"""Token ids of a corpus as Parquet files of id lists, in the order of documents.

A folder holds the documents' ids as one stream, cut into shards by ranges of ``doc_id``. A row is a document: ``doc_id``, ``at`` (ids of
the shard before it), ``n_tokens`` and ``ids``. Ids are encoded by a dictionary (a row group uses few of the vocabulary's ids, so
that an index takes fewer bits than an id), the other numbers by their differences, which ascend. Row groups and pages are kept small
enough that page indexes over ``doc_id`` and ``at`` narrow a read to the pages of the documents it asks for, and a read of counts
and places opens no page of ids. Spark's own writer commits the files, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.llm.common import by_key

VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.json", 0
#: Bytes of a row group and rows of a page at most; bytes of a page at about.
GROUP_BYTES, PAGE_ROWS, PAGE_BYTES = 8 << 20, 64, 1 << 16
#: Characters of text in a shard at about.
SHARD_CHARS = 64 << 20
#: Units of text of which a Python worker keeps the ids; characters of text encoded at once (or one longer text).
CACHED, AT_ONCE = 400_000, 1 << 21
#: White space before a blank, in RE2.
BLANK_AFTER_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\pZ] "
SCHEMA = "doc_id {kind}, shard int, at long, n_tokens long, ids array<int>"


class Encoder:
    """Texts to ids with the tokenizers library, each unit of text once.

    The vocabulary's pattern lets no word go over a blank that follows a character other than white space: such a blank begins
    the next word. So ids of the parts between those places, joined, are the ids of the text. Parts and their ids are kept in
    a table, of which the parts used last stay when it is full; a batch's parts are looked up in it together. Parts that are not
    known are encoded as one text and told apart by their bytes.
    """

    def __init__(self, vocabulary: str) -> None:
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        pre, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder()
        self.by_parts = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None and not any(" " in t.content for t in added.values())
        self.n_bytes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # a character of a byte-level token stands for a byte
            self.n_bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        # the same merges without the pattern, for what is one word; its characters stand for their own bytes, and Ġ for a blank
        self.merges = Tokenizer(self.tokenizer.model)  # shared, not copied
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # the known parts, how many ids each has, its ids one after the other, and the batch that used it last
        self.parts, self.counts, self.ids, self.used, self.batch = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def _each(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _joined(self, parts: list[str], tokenizer, between: str) -> list[bytes]:
        """Ids of parts that are encoded as one text, in which ``between`` stands before the first and between all."""
        out: list[bytes] = []
        for k in range(0, len(parts), 1 << 15):
            some = parts[k : k + (1 << 15)]
            ids = np.array(tokenizer.encode_batch_fast([between[-1] + between.join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum([1 + len(p) if p.isascii() else 1 + len(p.encode()) for p in some])
            bounds, raw = [0, *(4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1)).tolist()], ids.tobytes()
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that have a blank before them and don't end in white space. A part of plain letters is one word with its blank, so
        only its merges are left to do; of the others the vocabulary's pattern finds the words."""
        words = [p.isascii() and p.isalpha() for p in parts]
        found = iter(self._joined([p for p, w in zip(parts, words, strict=True) if w], self.merges, "\nĠ"))
        other = iter(self._joined([p for p, w in zip(parts, words, strict=True) if not w], self.tokenizer, " "))
        return [next(found if w else other) for w in words]

    def _learn(self, parts: list[str]) -> None:
        """Adds parts to the table."""
        import pyarrow as pa

        odd = [not p[-1:].strip() for p in parts]  # those that end in white space, or are a text's last blank
        plain = iter(self._of_parts([p for p, o in zip(parts, odd, strict=True) if not o]))
        rest = iter(self._each([" " + p for p, o in zip(parts, odd, strict=True) if o]))
        new = [next(rest).tobytes() if o else next(plain) for o in odd]
        self.parts = pa.concat_arrays([self.parts, pa.array(parts, pa.large_string())])
        self.counts = np.concatenate([self.counts, np.array([*map(len, new)], np.int64) // 4])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(new), np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(parts), np.int64)])

    def _forget(self) -> None:
        """Keeps three quarters of a full table, what was used last."""
        import pyarrow as pa

        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 4 :])
        starts = np.cumsum(self.counts) - self.counts
        self.ids = self.ids[_spans(starts[keep], self.counts[keep])]
        self.parts, self.counts, self.used = self.parts.take(pa.array(keep)), self.counts[keep], self.used[keep]

    def encode(self, texts, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow array of strings without null: how many ids each has, and the ids one after the other; ``tail`` ends each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_parts:
            own = [np.concatenate([x, tail]) for x in self._each(texts.to_pylist())]
            return np.array([len(x) for x in own], np.int64), np.concatenate([np.zeros(0, np.int32), *own])
        texts = texts.cast(pa.large_string())
        if pc.any(pc.match_substring_regex(texts, BLANK_AFTER_BLANK)).as_py():
            split = [[p[1:] if k else p for k, p in enumerate(re.split(r"(?<=\S)(?= )", t))] for t in texts.to_pylist()]
            n_parts, flat = np.array([*map(len, split)]), pa.array([p for parts in split for p in parts], pa.large_string())
        else:
            split = pc.split_pattern(texts, " ")
            n_parts, flat = pc.list_value_length(split).to_numpy(), split.flatten()
        self.batch += 1
        first = np.cumsum(n_parts) - n_parts
        head = np.zeros(len(flat), bool)
        head[first] = True
        later = flat.filter(pa.array(~head))
        at, had = pc.index_in(later, value_set=self.parts), len(self.parts)
        new = later.filter(pc.is_null(at)).dictionary_encode()
        unknown, at = at.is_null().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
        if len(new):
            self._learn(new.dictionary.to_pylist())
            at = at.copy()
            at[unknown] = had + new.indices.to_numpy()
        self.used[at] = self.batch
        heads, n = self._each(flat.take(pa.array(first)).to_pylist()), len(self.counts)
        ids = np.concatenate([self.ids, *heads, tail])
        counts = np.concatenate([self.counts, np.array([*map(len, heads), len(tail)], np.int64)])
        which = np.full(len(flat) + len(first), n + len(heads), np.int32)  # a text's first part, its later ones, the tail
        place = np.arange(len(flat)) + np.repeat(np.arange(len(first)), n_parts)
        which[place[head]], which[place[~head]] = n + np.arange(len(heads)), at
        starts = np.cumsum(counts) - counts
        del flat, later, at, place
        times = counts[which]
        found = ids[_spans(starts[which], times)]
        sums = np.add.reduceat(times, first + np.arange(len(first))) if len(first) else np.zeros(0, np.int64)
        if len(self.counts) > CACHED:
            self._forget()
        return sums, found


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, and so on."""
    out = np.arange(int(counts.sum()), dtype=np.int32)
    out += np.repeat((starts - (np.cumsum(counts) - counts)).astype(np.int32), counts)
    return out


@lru_cache(1)
def _encoder(vocabulary: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
    return Encoder(vocabulary)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes the ids of all texts of ``docs``, with the id ``end`` after each document, in ascending order of ``doc_id``, null first.

    Null and empty texts have the id ``end`` alone. Texts are encoded whole; strings of special tokens become those tokens, as
    the library's default has it. Rows that share an id are ordered by a hash of their texts, and repeated rows all stay; one
    id's rows may fill many shards. Further columns are left out. An empty table gives a folder without rows. ``path`` must be new.
    ``shards``: how many; by the size of the texts if not given.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    file = f"file://{vocabulary}" if vocabulary.startswith("/") else vocabulary
    model = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(file).select("content").first()[0]).decode())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        shards = int((rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS) + 1
        shards = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # copies of a row have a number each, so that no row's copies need to fit one shard
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged = ranged.withColumn("shard", F.spark_partition_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail = np.array([] if end is None else [end], np.int32)

    def batches(parts):
        import pyarrow.compute as pc

        encoder, at = _encoder(model.value), 0
        for part in parts:
            texts = pc.fill_null(part.column(1), "")
            edges = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                counts, ids = encoder.encode(texts[a:b], tail)
                starts = np.cumsum(counts) - counts
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, counts.sum()), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0)[a:b], part.column(2)[a:b], pa.array(at + starts), pa.array(counts), lists], ["doc_id", "shard", "at", "n_tokens", "ids"])
                at += int(counts.sum())

    out = ranged.mapInArrow(batches, SCHEMA.format(kind=kind)).write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
    out = out.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    for name in ("doc_id", "at", "n_tokens"):
        out = out.option(f"parquet.enable.dictionary#{name}", "false")  # differences then
    out.parquet(path)


class TokenFiles:
    """A folder that ``write`` has made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(path)

    def shards(self) -> DataFrame:
        """One row per shard: shard, n_docs, n_tokens and ``base``, the ids of all shards before it. Reads no ids.

        The running sum is over one row per shard, in one task: a shard has some 64 MB of text."""
        from pyspark.sql import Window

        sums = self.rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return by_key(rows, self.shards().select("shard", "base"), "shard").withColumn("start", F.col("base") + F.col("at")).drop("base", "at", "shard")

    def places(self) -> DataFrame:
        """(doc_id, n_tokens, start) of every document, ``start`` being the ids of all documents before it. Reads no ids."""
        return self._placed(self.rows.drop("ids"))

    def documents(self, where: Column | str | None = None) -> DataFrame:
        """(doc_id, n_tokens, ids, start) of the documents for which ``where``, a condition on ``doc_id``, holds; row groups and pages of
        others are not read."""
        return self._placed(self.rows if where is None else self.rows.where(where))

    def between(self, first: int, last: int) -> DataFrame:
        """(doc_id, start, ids) of what positions ``first`` to ``last`` - 1 of the stream hold; ``start`` is the first such position of the
        document. Shards outside are not read, and of the two at the ends only the pages that overlap."""
        ends = self.shards().where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).agg(F.min(F.struct("shard", "base")).alias("a"), F.max(F.struct("shard", "base")).alias("b")).first()
        if ends["a"] is None:
            return self.rows.select("doc_id", F.lit(0).cast("long").alias("start"), "ids").limit(0)
        inside = F.col("shard").between(ends["a"]["shard"], ends["b"]["shard"])
        inside &= (F.col("shard") < ends["b"]["shard"]) | (F.col("at") < last - ends["b"]["base"])
        found = self._placed(self.rows.where(inside)).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
        skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
        count = F.least(F.col("start") + F.col("n_tokens"), F.lit(last)) - F.col("start") - skip
        return found.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), count.cast("int")).alias("ids"))


@F.pandas_udf(T.LongType())
def crc32_of_ids(ids: pd.Series) -> pd.Series:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(np.asarray(x).astype("<u4").tobytes()) for x in ids], dtype="int64")
