"""The stages of the pipeline, each on the output of the one before, against brute force; and the queries against SQL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import toxicity
from shardloom.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA, same
from tests.llm.test_llm import slow_components, slow_statistics, slow_targets


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLE[name])


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def test_stages(spark, stages):
    names = list(stages)
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    before, after = stages["documents"], stages["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}
    lines = stages["line_dedup"]
    assert lines.count() == after.count()
    seen = Counter()
    for r in lines.orderBy("doc_id").collect():
        seen.update({x for x in r["text"].split("\n") if len(x.split()) >= 50})
    assert max(seen.values()) == 1
    rows = lines.collect()
    kept = {r["doc_id"] for r in stages["simhash"].collect()}
    assert kept == {c for _, _, c in slow_components(rows)[0]}
    sizes, own = Counter(), {}
    for r in stages["simhash"].collect():
        own[r["doc_id"]] = r["source"], slow_statistics(r["text"])[0]
        sizes[r["source"]] += own[r["doc_id"]][1]
    taken, want, copies = Counter(), slow_targets(dict(sizes)), Counter()
    for r in stages["mixing"].collect():
        taken[r["source"]] += own[r["doc_id"]][1]
        copies[r["doc_id"]] += 1
    for s in want:  # sources have 8 to 10 documents here: none that is left out, or was added last, would bring the sum nearer
        step = [n for d, (x, n) in own.items() if x == s and n]
        gap = want[s] - taken[s]
        epochs = min(copies[d] for d, (x, n) in own.items() if x == s and n)
        left = [n for d, (x, n) in own.items() if x == s and n and copies[d] == epochs]
        assert abs(gap) <= max(1, 0.1 * want[s], min(left if gap > 0 else step) / 2, max(step) / 2 if gap < 0 else 0)
        assert gap <= 0 or epochs == 3 or all(abs(gap - n) >= gap - 1 for n in left)
    last = stages["encoding"]
    assert last.count() == stages["mixing"].count() and last.where("not round_trip or n_ids = 0").count() == 0


def test_run_is_the_stages(spark, stages):
    key = lambda df: Counter((r["doc_id"], r["n_ids"]) for r in df.select("doc_id", F.col("n_ids")).collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(stages["encoding"])


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with the operators' own names, and no rows at all."""
    docs, own = spark.read.parquet(f"{DATA}/documents.parquet"), ("fp", "n_lines", "n_dropped", "size", "target", "score", "sid", "ids", "key", "rid")
    text = docs.where("n_chars > 500").first()["text"]
    odd = spark.createDataFrame([(None, None, None, None, None), (9**9, None, "en", "src1", 0), (9**9 + 1, "", "en", None, 0), (9**9 + 1, "", "en", None, 0), (None, text, "en", "src1", 1), (9**9 + 2, "word " * 50_000, None, "src1", 1)], docs.schema)
    rows = docs.limit(60).unionByName(odd).unionByName(docs.limit(3)).withColumns({c: F.lit("own") for c in own})
    for k, docs in enumerate((rows, rows.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "encoding" or out.columns == rows.columns
            out.write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
            assert name == "encoding" or docs.where(" or ".join(f"{c} <> 'own'" for c in own)).count() == 0
        assert (docs.count() > 0) == (k == 0)
