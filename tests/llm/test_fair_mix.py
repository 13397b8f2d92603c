import hashlib
import re

import duckdb
import pytest

from tidelog.llm import fair_mix as M
from tidelog.llm.queries import op5_fair_mix


def test_query_against_sql(spark, sf):
    big = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{big}/documents.parquet'")
    want = sorted(con.sql(M.SQL).fetchall())
    got = sorted(tuple(r) for r in op5_fair_mix(spark, big).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3], rel=1e-12)


ROWS = [(k, "w " * (k % 7 + 1), ["a", "b", None, "é", "tiny"][k % 5] if k % 50 else "tiny", 3) for k in range(400) if k % 5 != 4 or k % 50 == 4] + [
    (1000, None, "a", 0), (1001, "", "b", 0), (1002, " \n ", "void", 3), (None, "x y", "a", 3), (5, "p q r", "a", 5), (5, "p q r", "a", 5),
]


def brute(rows, last=(None,), quantum=256):
    size = lambda t: len(re.findall(M.WORDS, t or ""))
    sources = sorted({s for _, _, s, _ in rows if s is not None}) + list(last or ())
    total = {s: sum(size(t) for _, t, q, _ in rows if q == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    budget, target = 1.5 * sum(total.values()), {}
    while True:  # cap, and share the excess again
        free = [s for s in sources if s not in target]
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
    queues, quanta = {}, []
    for s in sources:
        at = 0
        queues[s] = sorted((hashlib.md5(str("" if d is None else d).encode()).hexdigest(), -1 if d is None else d, size(t)) for d, t, q, _ in rows if q == s)
        for place, (_, _, z) in enumerate(queues[s]):
            for e in (0, 1):
                start = at + e * total[s]
                for k in range(0, z, quantum):
                    upto = start + min(z, k + quantum)
                    quanta.append((upto / target[s], "n" if s is None else f"s{s}", upto, min(quantum, z - k), s, place))
            at += z
    taken, left = {}, int(min(1.5, 2) * sum(total.values()))
    for *_, words, s, place in sorted(quanta):  # in order of virtual finish times, up to the budget
        taken[s, place] = taken.get((s, place), 0) + min(words, left)
        left -= min(words, left)
    return sorted((d, z, total[s], round(target[s], 6), taken.get((s, k), 0)) for s in sources for k, (_, d, z) in enumerate(queues[s]))


def test_edges_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS copies")
    for quantum in (256, 3):
        rows = M.schedule(docs, ["doc_id"], quantum=quantum).collect()
        got = sorted((-1 if r.row.doc_id is None else r.row.doc_id, r["size"], r.source_size, round(r.target, 6), sum(c.taken for c in r.copies)) for r in rows)
        assert got == brute(ROWS, quantum=quantum)
        assert sum(t for *_, t in got) == int(1.5 * sum(z for _, z, *_ in got))
    got = brute(ROWS)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(M.WORDS, r.text)) for r in mixed.collect())
    assert words == sum(t for *_, t in got)
    assert all(r.n_chars in (3, 5) or r.n_chars == len(r.text) for r in mixed.collect())


def test_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long").limit(0)
    assert M.schedule(docs, ["doc_id"]).count() == 0 and M.mix(docs).count() == 0


def test_the_order_of_service_decides(spark, sf, monkeypatch):
    query = lambda: {r.doc_id: r.taken for r in op5_fair_mix(spark, sf).collect()}
    fair = query()
    monkeypatch.setattr(M, "ORDER", ("queue", "upto", "finish"))
    assert query() != fair and sum(query().values()) == sum(fair.values())


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a", 1), (2, "v " * 10, "a", 1), (3, "u " * 200_000, "b", 1)], "doc_id long, text string, source string, n_chars long")
    rows = {r.row.doc_id: r for r in M.schedule(docs, ["doc_id"]).collect()}
    for own in ((1, 2), (3,)):
        assert abs(sum(c.taken for d in own for c in rows[d].copies) - rows[own[0]].target) <= 2 * 256
    assert sum(len(r.text.split()) for r in M.mix(docs).collect()) == int(1.5 * 500_010)
