"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import compaction, embeddings, lengths, mixing, negatives, periods, pieces, quality, simhash, templates, token_files, toxicity, urls
from shardloom.llm.common import WORD, bind, checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.token_counts(_table(spark, sf_dir, "documents").select("text")))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are read back from the compacted store; ``shard_bound``: no shard is over the target."""
    store = compaction.ShardStore(spark, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append(_table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    bound = all(s.bytes <= compaction.TARGET for s in store.shards())
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.lit(bound).alias("shard_bound"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.without_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_ids", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def with_repetitions(docs: DataFrame) -> DataFrame:
    """``docs``, of which a tenth repeat a part of their words to the end, as a hash of the id says; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def repeated(w):
        n = F.size(w)
        return bind(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda v: F.array_join(F.transform(w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, (v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " "))

    return docs.withColumn("text", F.when((h % 10 == 0) & F.rlike("text", F.lit(WORD)), bind(words, repeated)).otherwise(F.col("text")))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.periodic_runs(with_repetitions(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids as they are read back from the files."""
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), path)
    found = token_files.TokenFiles(spark, path).documents()
    return found.select("doc_id", "start", "n_tokens", token_files.crc32_of_ids("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_counts, op3_near_vectors, op4_url_filter, op5_quality, op6_toxicity, op7_mixing, op8_compaction, op9_line_templates, op10_pieces, op11_periods, op12_token_files, op13_hard_negatives)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# A run: of the documents after the last run's end that fit the rest, those of which the sum down the keys stays within it.
_RUNS = "".join(
    f"""f{r} AS (SELECT *, after AND size <= rest AS fits FROM t{r - 1}),
r{r} AS (SELECT *, CASE WHEN fits THEN sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key DESC, doc_id DESC, size DESC) END AS total FROM f{r}),
c{r} AS (SELECT source, coalesce(max(CASE WHEN total <= rest THEN total END), 0) AS had, min(CASE WHEN total > rest THEN total END) AS over FROM r{r} GROUP BY source),
l{r} AS (SELECT r{r}.source, max(key) AS last FROM r{r} JOIN c{r} ON r{r}.source IS NOT DISTINCT FROM c{r}.source WHERE total = over GROUP BY r{r}.source),
t{r} AS (SELECT r{r}.doc_id, r{r}.source, size, key, CAST(rest - had AS BIGINT) AS rest, taken OR coalesce(total <= rest AND (over IS NULL OR total < over), FALSE) AS taken, coalesce(key <= last, FALSE) AS after
  FROM r{r} JOIN c{r} ON r{r}.source IS NOT DISTINCT FROM c{r}.source LEFT JOIN l{r} ON r{r}.source IS NOT DISTINCT FROM l{r}.source),
"""
    for r in (1, 2, 3)
)

ORACLE = {
    "op3_near_vectors": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
walk AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, walk.c AS component_id, walk.c = v.vec_id AS kept
FROM v JOIN walk ON walk.a = v.vec_id""",
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, source, text, CAST(len({_WORDS}) AS BIGINT) AS size, length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols FROM documents),
k AS (SELECT *, 1 + CASE WHEN size >= 20 THEN 1 ELSE 0 END + CASE WHEN symbols * 10 < size THEN 1 ELSE 0 END + CASE WHEN symbols * 50 < size THEN 1 ELSE 0 END
    + CASE WHEN length(text) > size * 3 AND length(text) < size * 12 THEN 1 ELSE 0 END AS w,
  (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
doc AS (SELECT doc_id, source, size, CASE WHEN w = 1 THEN u ELSE pow(u, 1::DOUBLE / w) END AS key FROM k),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 3 AS most FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, coalesce(least(CAST(most AS DOUBLE), weight * (SELECT level FROM s2 WHERE level * weight <= most ORDER BY most::DOUBLE / weight, source NULLS LAST LIMIT 1)), 0) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS e,
  CASE WHEN source_size > 0 THEN CAST(round(target - floor(target / source_size) * source_size) AS BIGINT) ELSE 0 END AS g FROM s3),
s AS (SELECT source, source_size, target, CASE WHEN source_size > 0 AND g >= source_size THEN e + 1 ELSE e END AS epochs, CASE WHEN g >= source_size THEN 0 ELSE g END AS goal FROM s4),
t0 AS (SELECT doc.*, goal AS rest, FALSE AS taken, TRUE AS after FROM doc JOIN s ON doc.source IS NOT DISTINCT FROM s.source WHERE size > 0),
{_RUNS}
extra AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY abs(size - rest), key, doc_id) AS n FROM t3 WHERE NOT taken AND abs(size - rest) < rest)
SELECT doc.doc_id, doc.size, s.source_size, s.target,
  CAST(doc.size * CASE WHEN doc.size = 0 THEN 0 ELSE s.epochs + CASE WHEN t3.taken OR extra.doc_id IS NOT NULL THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM doc JOIN s ON doc.source IS NOT DISTINCT FROM s.source LEFT JOIN t3 ON t3.doc_id = doc.doc_id LEFT JOIN extra ON extra.doc_id = doc.doc_id AND extra.n = 1""",
    "op8_compaction": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, TRUE AS shard_bound FROM documents",
    "op9_line_templates": r"""
WITH RECURSIVE part AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM part),
tok AS (SELECT doc_id, pos, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS t FROM raw),
l AS (SELECT doc_id, pos, len(t) AS n, array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS line, t FROM tok WHERE len(t) >= 5),
brief AS (SELECT doc_id, pos, array_to_string(t, ' ') AS line FROM tok WHERE len(t) BETWEEN 1 AND 4),
often AS (SELECT line, min(doc_id) AS lo FROM brief GROUP BY line HAVING count(DISTINCT doc_id) >= 5),
exact AS (SELECT n, leaf, line, any_value(t) AS t, min(doc_id) AS lo, max(doc_id) AS hi, min(CAST(doc_id AS HUGEINT) * 1000000000 + pos) AS ord FROM l GROUP BY n, leaf, line),
walk AS (SELECT n, leaf, line, t, ord, first_value(line) OVER w AS leader, first_value(t) OVER w AS theirs FROM exact WINDOW w AS (PARTITION BY n, leaf ORDER BY ord)
  UNION ALL SELECT n, leaf, line, t, ord, first_value(line) OVER w, first_value(t) OVER w FROM walk
  WHERE len(list_filter(list_zip(t, theirs), lambda z: z[1] = z[2])) < ceil(round(n * 0.7, 6)) WINDOW w AS (PARTITION BY n, leaf ORDER BY ord)),
named AS (SELECT n, leaf, line, leader FROM walk WHERE len(list_filter(list_zip(t, theirs), lambda z: z[1] = z[2])) >= ceil(round(n * 0.7, 6))),
grp AS (SELECT n, leaf, leader, min(lo) AS lo, max(hi) AS hi FROM named JOIN exact USING (n, leaf, line) GROUP BY n, leaf, leader),
dropped AS (SELECT l.doc_id, l.pos FROM l JOIN named USING (n, leaf, line) JOIN grp USING (n, leaf, leader) WHERE lo <> hi AND l.doc_id <> lo
  UNION ALL SELECT doc_id, pos FROM brief JOIN often USING (line) WHERE doc_id <> lo),
gone AS (SELECT doc_id, list(pos) AS drops FROM dropped GROUP BY doc_id)
SELECT part.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped,
  md5(CASE WHEN drops IS NULL THEN text ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(drops, i - 1)), chr(10)), '') END) AS text_md5
FROM part LEFT JOIN gone USING (doc_id)""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, r.vec_id AS other, q.label = r.label AS alike, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10""",
}
