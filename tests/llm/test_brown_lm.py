import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import brown_lm as B
from tidelog.llm.queries import op7_brown_lm


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]


def base(docs, learns):
    c = Counter(w for d, t in docs if learns(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t in docs}


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


@pytest.mark.parametrize("head", [B.HEAD, 300])
def test_query_against_brute_force(spark, sf, head, monkeypatch):
    monkeypatch.setattr(B, "HEAD", head)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = base(docs, lambda d: not held(d))
    rows = op7_brown_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, low = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert r.base_score == pytest.approx(low, rel=1e-9)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def likelihood(counts, cls, n):
    one = np.eye(n)[cls]
    big = one.T @ counts @ one
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(big) - f(big.sum(axis=0)) - f(big.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, (12, 12)).astype(float)
    cls = B.exchange(counts, 4, fixed=11, sweeps=50)
    assert cls[11] == 0 and (cls[:11] > 0).all()
    best = likelihood(counts, cls, 4)
    for w in range(11):
        for c in (1, 2, 3):
            other = cls.copy()
            other[w] = c
            assert likelihood(counts, other, 4) <= best + 1e-6


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(k, "the cat sat . a dog ran .") for k in range(5)] + [(9, "rare thing")], "doc_id long, text string")
    m, _ = B.learn(docs, F.lit(True))
    assert np.allclose((10**m.log_trans).sum(axis=1), 1)
    vocab = ["the", "cat", "sat", ".", "a", "dog", "ran", "rare", "thing"]
    c = Counter(w for k in range(5) for w in words("the cat sat . a dog ran .")) + Counter(words("rare thing"))
    import pyarrow as pa

    key, _ = B.tokens(pa.array(vocab))
    cls = dict(zip(vocab, m.classes[m.elements.of(key[::2])], strict=True)) | {None: m.classes[m.elements.n_words]}
    for k in set(cls.values()):
        mass = sum(c[w] + 0.5 for w in cls if cls[w] == k) + 0.5
        assert mass / 10 ** m.log_den[k] == pytest.approx(1)


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "a " * 30000), (5, "Same text"), (5, "Same text"), (None, "same other"), (6, "É é")]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS rid", "3 AS tail")
    for learns in (F.col("doc_id").isNotNull(), F.lit(False)):
        rows = B.score(docs, *B.learn(docs, learns)).collect()
        assert len(rows) == len(EDGES)
        by = {r.doc_id: r for r in rows}
        assert (by[1].n_tokens, by[3].n_tokens, by[4].n_tokens, by[None].n_tokens) == (1, 1, 30001, 3)
    assert by[1].train_tokens == 0 and by[1].base_score == pytest.approx(0)
    assert B.score(docs.limit(0), *B.learn(docs, F.lit(True))).count() == 0


def test_further_words_move_to_their_best_class():
    rng = np.random.default_rng(7)
    counts = rng.poisson(1.5, (30, 30)) * rng.integers(1, 12, (30, 30)).astype(float)
    cls = np.append(0, rng.integers(1, 5, 29))
    one = np.eye(5)[cls]
    words = np.arange(1, 30)
    alone = counts[words, words]
    rest = counts - np.diag(np.diag(counts))
    got = B.Moves(one.T @ counts @ one).best(cls[1:], (rest @ one)[1:], (rest.T @ one)[1:], alone)
    for w in words:
        each = [likelihood(counts, np.where(np.arange(30) == w, c, cls), 5) for c in range(1, 5)]
        assert each[got[w - 1] - 1] == pytest.approx(max(each), abs=1e-6)
    assert (got != cls[1:]).any()


def test_every_learning_word_has_a_class_by_its_own_bigrams(spark, monkeypatch):
    """Beyond the exchanged words, words of one suffix group part by what stands around them."""
    monkeypatch.setattr(B, "WORDS", 6)
    docs = [(k, "left p right up q down " * 5 + f"left x{k % 20}same right up y{k % 20}same down") for k in range(60)]
    m, further = B.learn(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(True))
    rows = {r.key: (r.n, r.cls) for r in further.collect()}
    c = Counter(w for _, t in docs for w in words(t))
    import pyarrow as pa

    names = sorted(w for w in c if w)
    key = dict(zip(names, B.tokens(pa.array(names))[0][::2].view(np.int64).tolist(), strict=True))
    top = {k for k in np.asarray(list(key.values()))[m.elements.of(np.array(list(key.values())).view(np.uint64)) < m.elements.n_words].tolist()}
    assert len(top) == m.elements.n_words and set(rows) == set(key.values()) - top
    assert all(rows[key[w]][0] == c[w] for w in names if key[w] not in top)
    xs, ys = ({rows[key[w]][1] for w in names if w[0] == a and w.endswith("same")} for a in "xy")
    assert xs and ys and not xs & ys  # one suffix group


def test_words_of_one_frequency_are_cut_by_hash(spark, monkeypatch):
    """Where the most frequent words are too many, a share of them is clustered, not none."""
    monkeypatch.setattr(B, "HEAD", 5)
    docs = spark.createDataFrame([(k, "a b c d e f g h i j") for k in range(9)], "doc_id long, text string")
    m, further = B.learn(docs, F.lit(True))
    assert 1 <= m.elements.n_words <= 9 and m.elements.n_words + further.count() == 10


@pytest.mark.parametrize("n_words", [3, 2047])
def test_scores_against_brute_force(spark, monkeypatch, n_words):
    """Given the classes, all counts, transitions and probabilities are recomputed from the texts."""
    import pyarrow as pa

    monkeypatch.setattr(B, "WORDS", n_words)
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(rng.choice(["sun", "moon", "rose", "fell", "the", "The", "a", f"only{k}ing", "x"], int(rng.integers(0, 25))))) for k in range(40)] + [(50, None), (51, "unseen words here rising")]
    learns = lambda d: d < 30
    m, further = B.learn(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 30)
    own = {r.key: r.cls for r in further.collect()}
    c = Counter(w for d, t in docs if learns(d) for w in words(t))

    def cls(w):
        if w is None:
            return m.end_class
        key = B.tokens(pa.array([w]))[0][:1]
        at = int(m.elements.of(key)[0])
        return int(m.classes[at]) if at < m.elements.n_words else own.get(int(key.view(np.int64)[0]), int(m.group_classes(key)[0]))

    assert set(own.values()) <= set(range(B.CLASSES)) and all(cls(w) != m.end_class for w in c if w)
    pairs, n = Counter(), B.CLASSES
    for d, t in docs:
        if learns(d):
            seq = [m.end_class, *map(cls, words(t))]
            pairs.update(zip(seq[:-1], seq[1:], strict=True))
    left, right = Counter(), Counter()
    for (a, b), k in pairs.items():
        left[a] += k
        right[b] += k
    share = {k: (right[k] + 1) / (sum(right.values()) + n) for k in range(n)}
    kinds = Counter(cls(w) for w in c)
    want = {}
    for d, t in docs:
        seq = [(None, m.end_class), *((w, cls(w)) for w in words(t))]
        want[d] = sum(
            math.log10((pairs[a, b] + B.BETA * share[b]) / (left[a] + B.BETA)) + math.log10((c[w] + 0.5) / (right[b] + 0.5 * (kinds[b] + 1))) for (_, a), (w, b) in zip(seq[:-1], seq[1:], strict=True)
        )
    rows = B.score(spark.createDataFrame(docs, "doc_id long, text string"), m, further).collect()
    assert {r.doc_id: r.score for r in rows} == {d: pytest.approx(x, rel=1e-9) for d, x in want.items()}
