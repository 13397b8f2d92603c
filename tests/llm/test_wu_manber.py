import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tidelog.llm.queries import op8_wu_manber
from tidelog.llm.wu_manber import PER_WORD, build, clean, passages, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            p = words(it)
            m = min(window, len(p))
            wins = {tuple(p[a : a + m]) for a in range(len(p) - m + 1)} if m else set()
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in wins:
                    hit.update(range(a, a + m))
                    if i is not None:
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in op8_wu_manber(spark, sf).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert len(got) == len(want)
    assert any(n for _, n, _ in want.values())
    for d, (n, hit, found) in want.items():
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


EDGES = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "..."), (5, "tiny"), (5, "tiny"),
    (6, "x Tiny y SMALL-Pair z"), (7, "zero ONE two, three four five six seven eight nine ten!"), (8, "a " * 5000 + "tiny"),
    (9, "one two three four five six seven eight nine"), (None, "tiny é"), (10, "één tiny-één small pair pair"),
]
ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "tiny"), (2, "tiny"), (3, "small pair"), (4, None), (5, " "), (None, "één"), (20, "a a a a a a a a a a a")]


def test_edges_blocks_and_clean(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'k' AS items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(EDGES, ITEMS)
    for block in (1 << 20, 700):
        rows = passages(docs, bench, table_bytes=block).collect()
        assert len(rows) == len(EDGES)
        for r in rows:
            assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id]
            assert sum(r.span_ends) - sum(r.span_starts) == r.n_hit
        kept = clean(docs, bench, table_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _ in EDGES if d and want[d][1] == 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert passages(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in passages(docs, bench.limit(0)).collect())
    assert clean(docs, bench.limit(0)).count() == len(EDGES)


def test_memory_of_a_large_benchmark():
    rng = np.random.default_rng(5)
    words_ = np.array([f"w{k}" for k in rng.integers(0, 200_000, 2_500_000)])
    texts = pa.array([" ".join(words_[k : k + 2500]) for k in range(0, len(words_), 2500)])
    assert texts.nbytes > 16 << 20
    tracemalloc.start()
    block = build(pa.array([str(k) for k in range(len(texts))]), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert block.nbytes <= texts.nbytes + PER_WORD * len(words_) and peak < 500 << 20
    first, hit, pairs, n_hit = scan(pa.array([" ".join(["no", *words_[100:130], "no"]), " ".join(words_[2495:2505])]), block)
    assert n_hit.tolist() == [30, 0] and pairs.tolist() == [[0], [block.names.index("0")]]
