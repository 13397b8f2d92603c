import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import suffix_dedup as S
from tidelog.llm._bloom import spark_xxhash64
from tidelog.llm.queries import op9_suffix_dedup


def brute(docs, length=100):
    """docs: (id, text) in order; every window against all that start earlier."""
    seen, out = set(), []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_against_brute_force(spark, sf):
    for dir in (sf, sf.replace("0.001", "0.01")):
        docs = [tuple(r) for r in spark.read.parquet(f"{dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
        got = sorted(tuple(r) for r in op9_suffix_dedup(spark, dir).collect())
        assert got == brute(docs)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("crowd", [256, 1])
def test_passages_periods_and_edges(spark, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = np.random.default_rng(2)
    word = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    line, passage = word(97), word(260)
    docs = [(k, word(int(rng.integers(0, 90))) + line + word(30) + passage * int(rng.integers(0, 2)) + word(20)) for k in range(300)]
    docs += [(1000, "ab" * 300), (1001, "a" * 500), (1002, None), (1003, ""), (1004, "é" * 49 + "x"), (1005, "é" * 80), (1006, passage[:100]), (1007, passage[:99] + "!"), (1008, word(3000) + passage[5:160]), (1009, "a" * 99)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS n").repartition(7)
    got = S.remove_repeats(df).withColumn("n_spans", F.size("span_starts")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_long_texts_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1 << 10)
    rng = np.random.default_rng(4)
    base = "".join(map(chr, rng.integers(97, 101, 6000)))
    docs = [(1, base), (2, base[100:4000] + base[:700]), (3, base[::-1])]
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got.collect()) == [r[:3] for r in brute(docs)]


def test_null_and_equal_ids(spark):
    t = "".join(map(chr, np.random.default_rng(0).integers(97, 123, 150)))
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (8, "x" + t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.remove_repeats(df).collect())
    assert got == [(0, 0), (7, 150), (7, 150), (8, 150)]
    same = S.remove_repeats(df.filter("doc_id = 7")).collect()
    assert [r.n_removed for r in same] == [0, 0]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_suffix_array_and_hash(spark):
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (50, 2), (400, 3), (400, 250)):
        s = rng.integers(1, k, n).astype(np.uint16)
        assert [tuple(s[i : i + 30]) for i in S.suffix_array(s, 30)] == sorted(tuple(s[i : i + 30]) for i in range(n))
    x = rng.integers(-(2**62), 2**62, 20)
    df = spark.createDataFrame([(int(v), int(w)) for v, w in zip(x, x[::-1], strict=True)], "a long, b long")
    assert [r[0] for r in df.select(F.xxhash64("a", "b")).collect()] == spark_xxhash64(x, x[::-1].copy()).tolist()
