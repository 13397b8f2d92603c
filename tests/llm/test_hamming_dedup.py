import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import hamming_dedup as H
from tidelog.llm._components import components, joined, roots
from tidelog.llm.queries import op4_hamming_dedup


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k=2):
    """(id, set size, component) of every row, by all pairs."""
    sets = [shingle_set(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    seen, order = {}, []
    for i, s in enumerate(sets):
        key = frozenset(s)
        if s and key in seen:
            up[i] = seen[key]
        elif s:
            seen[key] = i
            order.append(i)
    for n, i in enumerate(order):
        for j in order[:n]:
            if 80 * len(sets[i]) <= 100 * len(sets[j]) and 80 * len(sets[j]) <= 100 * len(sets[i]):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return sorted(((-1 if d is None else d, len(sets[i]), ids.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def test_query_against_brute_force(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()]
    rows = op4_hamming_dedup(spark, big).collect()
    want = brute(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert any(d != c for d, _, c in want)


def variants(seed=3, copies=60):
    """Copies that are near a base but often not near one another, and edge cases."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    docs, at = [], 100
    for _ in range(4):
        base = rng.choice(words, 150).tolist()
        for _ in range(copies):
            w = list(base)
            for p in rng.choice(150, int(rng.integers(0, 9)), replace=False):
                w[p] = str(rng.choice(words))
            docs.append((at, " ".join(w)))
            at += 1
    docs += [(k, " ".join(rng.choice(words, int(rng.integers(1, 60))))) for k in range(5000, 5060)]
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b " * 9000), (8, "b a " * 9000), (9, "x y"), (9, "x y"), (None, "x Y"), (None, "solo word row")]
    rng.shuffle(docs)
    return [(None if d is None else int(d), t) for d, t in docs]


@pytest.mark.parametrize(("k", "light", "block"), [(2, 32, 256), (5, 32, 256), (2, 3, 7)])
def test_edges_and_near_copies(spark, k, light, block, monkeypatch):
    monkeypatch.setattr(H, "LIGHT", light)
    monkeypatch.setattr(H, "BLOCK", block)
    docs = variants()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS sid", "2 AS row")
    rows = H.classes(df, k=k).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(docs, k)
    kept = H.keep_one(df, k=k)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    want = {c for _, n, c in brute(docs, k) if n and c is not None}
    assert sorted(d for d in got if d not in (1, 2, 3, None)) == sorted(want)
    assert {1, 2, 3} <= set(got) and got.count(None) == 1


def test_all_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, H.VALUES).astype(np.uint16)
    for _ in range(200):
        other = base.copy()
        flip = rng.choice(H.VALUES, H.RADIUS, replace=False)
        other[flip] ^= rng.integers(1, 1 << 16, H.RADIUS).astype(np.uint16)
        sig = pa.ListArray.from_arrays(pa.array([0, H.VALUES // 4, H.VALUES // 2], pa.int32()), pa.array(np.stack([base, other]).view(np.int64).ravel()))
        (b,) = H._keys()([pa.RecordBatch.from_pydict({"sid": pa.array([0, 1]), "sig": sig})])
        key, sid = b.column("key").to_numpy(), b.column("sid").to_numpy()
        assert set(key[sid == 0]) & set(key[sid == 1])


def test_blocks_find_what_all_pairs_find():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(40, 60))], rng.integers(0, 1 << 40, int(rng.integers(1, 6))).astype(np.uint64)])) for _ in range(60)]
    j = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])

    def groups(pairs):
        own = list(range(60))
        for u, v in pairs:
            own = [own[u] if x == own[v] else x for x in own]
        return [own.index(x) for x in own]

    u, v = H.links_between(sets, None, 80)
    assert groups(zip(u, v)) == groups(zip(*np.nonzero(j >= 0.8)))
    u, v = H.links_between(sets[:25], sets[25:], 80)
    assert groups(zip(u, v)) == groups([(a, b) for a, b in zip(*np.nonzero(j >= 0.8)) if (a < 25) != (b < 25)])


def test_differing_and_components(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (2, 50, H.VALUES)).astype(np.uint16)
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a.view(np.int64), b.view(np.int64), strict=True)], "x array<long>, y array<long>")
    assert [r[0] for r in df.select(H.differing(F.col("x"), F.col("y"))).collect()] == (a != b).sum(axis=1).tolist()
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 70), (70, 90), (5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[k] for k in range(61)} == {got[0]} and got[100] == got[70] == got[90] != got[0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert H.classes(df).count() == 0 and H.keep_one(df).count() == 0


def test_forests_and_joined_components(spark):
    rng = np.random.default_rng(2)
    up = [(n, int(rng.integers(max(0, n - 3), n))) for n in range(1, 80) if n % 9]
    got = {r.node: r.comp for r in roots(spark.createDataFrame(up, "node long, up long")).collect()}
    to = dict(up)

    def root(n):
        return root(to[n]) if n in to else n

    assert got == {n: root(n) for pair in up for n in pair}
    labels = roots(spark.createDataFrame(up, "node long, up long"))
    more = [(1, 78), (200, 201), (5, 6)]
    after = {r.node: r.comp for r in joined(labels, spark.createDataFrame(more, "u long, v long")).collect()}
    assert after[200] == after[201] and after[1] == after[78] and len(set(after.values())) < len(set(got.values())) + 1
    assert {n: after[n] == after[1] for n in got} == {n: got[n] in (got[1], got[78]) for n in got}
    assert roots(spark.createDataFrame([], "node long, up long")).count() == 0


def test_template_pages_are_few_candidates(spark, monkeypatch):
    """Pages that share a template but are not near: no pairs come out of crowded keys."""
    rng = np.random.default_rng(8)
    template = [f"t{k}" for k in range(59)]
    docs = [(k, " ".join(template + [f"w{x}" for x in rng.integers(0, 1 << 40, 31)])) for k in range(600)]
    docs += [(1000 + k, docs[k][1] + " more") for k in range(5)]
    seen = {}
    kept = H.written
    monkeypatch.setattr(H, "written", lambda df, name="table": seen.setdefault(name, []).append(kept(df, name)) or seen[name][-1])
    rows = {r.doc_id: r.component_id for r in H.classes(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()}
    assert rows == {d: d - 1000 if d >= 1000 else d for d, _ in docs}
    assert seen["crowd"][0].count() > 100  # most meet in crowded keys
    assert sum(t.count() for t in seen["pairs"]) < 20 * len(docs) and sum(t.count() for t in seen["open"]) < 100 * len(docs)
