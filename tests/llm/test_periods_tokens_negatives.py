"""Periodic runs, token files and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import negatives, periods, queries, token_files
from tests.conftest import DATA, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# periodic runs


def plain_runs(words):
    """All maximal stretches of every period, the least period of each."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, length, q) for (s, length), q in found.items())


def sequences():
    rng = random.Random(5)
    for k in range(400):
        n = rng.randint(0, 400)
        if k % 4 == 0:
            yield [rng.randint(0, 1) for _ in range(n)]
        elif k % 4 == 1:
            block = [rng.randint(0, 5) for _ in range(rng.randint(1, max(1, n // 3)))]
            words = [block[i % len(block)] for i in range(n)]
            for _ in range(rng.randint(0, 2) if n else 0):
                words[rng.randrange(n)] = 9
            yield words
        elif k % 4 == 2:
            yield [0] * n
        else:
            words = []
            while len(words) < n:
                block = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
                words += (block * rng.randint(1, 6))[: rng.randint(1, 200)]
            yield words


def test_runs_against_all_periods():
    for words in sequences():
        assert [tuple(r) for r in periods.runs_of(np.array(words, np.int64)).tolist()] == plain_runs(words)


def test_runs_of_long_sequences():
    n = 60_000
    assert periods.runs_of(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert periods.runs_of(np.concatenate([np.zeros(n), [1], np.zeros(n)]).astype(np.int64)).tolist() == [[0, n, 1], [n + 1, n, 1]]
    assert periods.runs_of(np.arange(n) % (n // 3)).tolist() == [[0, n, n // 3]]
    assert periods.runs_of(np.arange(n)).tolist() == []


def repeated(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op11_on_every_document(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_periods(spark, DATA).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        words = repeated(r["doc_id"], WORD.findall(texts[r["doc_id"]] or ""))
        short = len(words) <= 1500  # brute force takes the square of a text's words
        runs = plain_runs(words) if short else [tuple(x) for x in periods.runs_of(np.unique(words, return_inverse=True)[1]).tolist()]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "x " * 30, 5), (3, "a b " * 24, 5), (3, "a b " * 24, 5), (4, "one two " * 40 + "end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r["doc_id"], r["n_words"]): r for r in periods.periodic_runs(df).collect()}
    assert len(got) == 5 and got[1, 0]["collapsed"] == "" and got[1, 0]["runs"] == [] and got[2, 0]["strongest"] is None
    assert got[None, 30]["collapsed"] == "x" and tuple(got[3, 24]["strongest"]) == (0, 24, 1)
    assert got[4, 81]["collapsed"] == "one two end"
    assert periods.periodic_runs(df.limit(0)).count() == 0


# token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.VOCABULARY)


def test_encoder_is_the_library(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CACHED", 40)  # so that parts are forgotten and come again
    encoder = token_files.Encoder(library.to_str())
    assert encoder.by_parts
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "'s", "1", "!", " ", "　", "é", "中", "<|endoftext|>", "\x1c", "\x85", "\r\n", " x", "'", " ", "\x00", "😀", "\x0b"]
    for k in range(60):
        texts = ["".join(rng.choice(parts[4:14:2] + [" "] if k % 2 else parts) for _ in range(rng.randint(0, 30))) for _ in range(50)]
        counts, ids = encoder.encode(pa.array(texts), np.array([7], np.int32))
        want = [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]
        assert counts.tolist() == [*map(len, want)] and ids.tolist() == [i for x in want for i in x]


def test_op12_on_every_document(spark, library):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    want, start = {}, 0
    for doc_id, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op12_token_files(spark, DATA).collect()}
    assert got == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "zebra's"]) for _ in range(rng.randint(0, 400))), "x", i) for i in rng.sample(range(3000), 600)]
    rows += [(9000, "copy of a row", "x", 1)] * 300 + [(9001, None, "x", 1), (None, "nameless", "x", 1), (9002, "", None, 1), (9003, "long " * 50_000, "x", 2)]
    path = str(tmp_path_factory.mktemp("tokens") / "files")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string, ids string, at int"), path, shards=7)
    return path, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_keep_order_and_copies(spark, folder, library):
    path, rows = folder
    files = token_files.TokenFiles(spark, path)
    want = [library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    stream = [i for ids in want for i in ids]
    got = sorted(files.documents().collect(), key=lambda r: r["start"])
    assert [i for r in got for i in r["ids"]] == stream and [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["n_tokens"] for r in got] == [*map(len, want)]
    assert files.shards().agg(F.sum("n_tokens")).first()[0] == len(stream)
    spread = [r["n"] for r in files.rows.where("doc_id = 9000").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(spread) == 300 and len(spread) > 1  # copies of one row fill several shards
    for first, last in ((0, 1), (17, 5000), (len(stream) - 3, len(stream) + 9), (100, 100), (10**9, 10**9 + 1), (0, len(stream))):
        part = sorted(files.between(first, last).collect(), key=lambda r: r["start"])
        assert [i for r in part for i in r["ids"]] == stream[first:last]
        assert not part or part[0]["start"] == first
    assert {r["doc_id"] for r in files.documents("doc_id between 100 and 300").collect()} == {r[0] for r in rows if r[0] and 100 <= r[0] <= 300}


def test_token_files_read_only_what_is_asked(spark, folder):
    import glob

    import pyarrow.parquet as pq

    path, _ = folder
    files = token_files.TokenFiles(spark, path)
    plan = files.places()._jdf.queryExecution().executedPlan().toString()
    assert all("ids" not in x for x in re.findall(r"ReadSchema: (.*)", plan))
    plan = files.documents("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    files = token_files.TokenFiles(spark, str(tmp_path / "none"))
    assert files.documents().count() == files.places().count() == files.between(0, 10).count() == 0


# hard negatives


def brute_negatives(rows, anchor, scale=256):
    good = {i: (lab, [int(np.floor(scale * x)) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for a, (lab, q) in good.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, v, strict=False)) for i, (_, v) in good.items()}
        ranked = sorted((i for i in good if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if good[i][0] == lab][:5]:
            fits = [i for i in ranked if good[i][0] != lab and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:10])}
    return out


def test_op13_matches_sql(spark, duck):
    same(queries.op13_hard_negatives(spark, DATA), duck, queries.ORACLE["op13_hard_negatives"])


@pytest.mark.parametrize("blocks", [(4096, 1 << 20, 4096), (3, 40, 16)])
def test_negatives_against_all_pairs(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "A_TASK"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(i % 3), (centres[i % 6] + 0.4 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, 0, rows[0][2]) for i in range(100)]  # a group of copies, ties
    rows += [(1000, None, [1.0] * 8), (None, 1, [1.0] * 8), (1010, 1, None), (1020, 1, [1.0, None] * 4), (1030, 2, [float("inf")] * 8), (1040, 2, [0.0] * 8), (1050, 7, [1.0] * 8), (1060, 1, [2.0, 1.0]), (1070, 1, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, goal string, rank int")
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_numbers_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (rng.normal(size=4) * 2e6).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows + rows + [(0, 1, [1.0] * 4), (50, 0, [1e300] * 4), (60, 1, [1e17] * 4)], "vec_id long, label int, embedding array<double>")
    got = {tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0).collect()}
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert max(r[4] for r in got) > 2**53
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("id") < 0).count() == 0


def test_brackets_pass_vectors_by(spark, monkeypatch):
    """Vectors in far clusters are not multiplied."""
    tried = []
    take = negatives._Block._take
    monkeypatch.setattr(negatives._Block, "_take", lambda self, a, scores, ids: (tried.append(len(ids)), take(self, a, scores, ids))[1])
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.normal(size=(500, 6)) * 0.05 + c for c in 3 * np.eye(6)[:4]]))
    most2 = float((x * x).sum(axis=1).max())
    pivots = negatives.choose_pivots(x, most2, negatives.PIVOTS)
    dist = negatives.distances(x, np.sqrt(most2 - (x * x).sum(axis=1)), pivots)
    goals = pa.array([[{"goal": 0, "low": int(x[0] @ x[0]) // 2, "high": 2**62}]], pa.list_(pa.struct([("goal", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])))
    part = lambda at, d: {"id": pa.array(at), "label": pa.array([i % 2 for i in at]), "vec": pa.array(x[at].astype(int).tolist()), "norm2": pa.array((x[at] ** 2).sum(axis=1)), "dist": pa.array(d.tolist())}
    block = negatives._Block(pa.RecordBatch.from_pydict(part([0], negatives.distances(x[:1], np.zeros(1), pivots)) | {"goals": goals}), 6, most2, 10, False, True)
    block.meet(pa.RecordBatch.from_pydict(part([*range(1, 2000)], dist[1:])))
    assert 0 < sum(tried) < 600
    want = sorted((-int(x[0] @ x[i]), i) for i in range(1, 500, 2))[:10]
    assert [(-r["score"], r["id"]) for r in block.found().to_pylist()] == want
