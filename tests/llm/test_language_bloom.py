import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import language_bloom as L
from tidelog.llm.queries import op1_language_bloom


def test_held_out_accuracy(spark, sf):
    rows = {r.doc_id: r for r in op1_language_bloom(spark, sf.replace("0.001", "0.01")).collect()}
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()
    assert len(rows) == len(docs)
    right = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]
    assert np.mean(right) > 0.97
    for d in docs:
        assert rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        assert 0 <= rows[d.doc_id].score <= 1


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat sat", "a"), ("the dog sat", "a"), ("le chat noir", "b"), ("le chien noir", "b")])], "doc_id long, text string, lang string")
    f = L.learn(docs, F.lit(True), min_docs=1, min_share=0)
    known = {"a": set(), "b": set()}

    def grams(t):
        s = " " + " ".join(t.lower().split()) + " "
        return [s[i : i + n] for n in L.ORDERS for i in range(len(s) - n + 1)]

    for r in docs.collect():
        known[r.lang] |= set(grams(r.text))
    for t in ("the noir cat", "chien", "THE  Cat!"):
        clean = "".join(c if c.isalpha() else " " for c in t)
        counts, total, _ = f.counts([t])
        assert total[0] == len(grams(clean))
        for k, lang in enumerate(f.languages):
            assert abs(counts[0, k] - sum(g in known[lang] for g in grams(clean))) < 0.1


EDGES = [(1, None, "a"), (2, "", "a"), (3, "123 !?", None), (4, "é", "b"), (5, "the cat", None), (6, "word " * 20000, "a"), (None, "the cat sat", "a"), (7, "the cat sat", "a"), (7, "the cat sat", "a"), (8, "猫 の", "b")]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string").selectExpr("*", "1 AS lang_pred", "2 AS score")
    f = L.learn(docs, F.lit(True), min_docs=1)
    rows = L.identify(docs, f).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert (by[1], by[2], by[3]) == ("und", "und", "und")
    assert (by[5], by[6], by[8]) == ("a", "a", "b")
    none = L.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), f).count() == 0


def test_query_against_brute_force(spark, sf):
    """Exact n-gram sets in place of the filters: the same languages, nearly the same scores."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def grams(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        return [s[i : i + n] for n in L.ORDERS for i in range(len(s) - n + 1)]

    taught = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 != 1 and d.lang is not None and d.text is not None]
    size = Counter(d.lang for d in taught)
    held = defaultdict(Counter)
    for d in taught:
        for g in set(grams(d.text)):
            held[g][d.lang] += 1
    known = {g: {k for k, m in n.items() if m >= 2 and m / size[k] >= 0.1 * max(x / size[j] for j, x in n.items())} for g, n in held.items()}
    got = {r.doc_id: r for r in op1_language_bloom(spark, sf).collect()}
    for d in docs:
        if not any(c.isalpha() for c in d.text or ""):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0)
            continue
        counts = Counter(k for g in grams(d.text) for k in known.get(g, ()))
        (best, top), *rest = sorted(counts.items(), key=lambda x: (-x[1], -size[x[0]], x[0])) or [(None, 0)]
        second = rest[0][1] if rest else 0
        if top - second > 3:
            assert got[d.doc_id].lang_pred == best
            assert abs(got[d.doc_id].score - top / (top + second)) < 0.02


def test_holders_against_brute_force():
    """Short texts, texts of one letter or none, and more different letters than one number can hold."""
    wide = "".join(c for c in map(chr, range(0x3400, 0xD7A4)) if c.isalpha())
    texts = ["a", None, "", "1", "ab", "abab ab", "The cat, the CAT", "le chat", "ab", "a b c d e"]
    for texts in (texts, texts + [wide], ["cat"], [None]):
        lang = np.array([k % 3 for k in range(len(texts))])
        x, text, _ = L.characters(texts)
        want = Counter()
        for h, own in L.ngrams(x, text):
            want.update((int(lang[t]), g) for g, t in set(zip(h.tolist(), own.tolist())))
        got = Counter()
        for of, h, n in L.holders(texts, lang):
            for k, g, m in zip(of.tolist(), h.tolist(), n.tolist()):
                assert (k, g) not in got
                got[k, g] = m
        assert got == want
