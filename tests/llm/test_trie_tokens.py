import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidelog.llm import trie_tokens as R
from tidelog.llm.queries import op6_trie_tokens

V = R.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


class Brute:
    """Best segmentations of single words from left to right, without a trie."""

    def __init__(self, scores: dict[str, float], byte: float):
        self.scores, self.byte, self.longest = scores, byte, max(map(len, scores))

    def best(self, word):
        """(score, tokens, pieces, bytes)."""
        at = [(0.0, 0, (), 0)]
        for e in range(1, len(word) + 1):
            found = None
            for k in range(1, min(e, self.longest) + 1):
                p = self.scores.get(word[e - k : e])
                s, n, used, b = at[e - k]
                if p is not None:
                    new = (s + p, n + 1, used + (word[e - k : e],), b)
                elif k == 1:
                    size = len(word[e - 1].encode())
                    new = (s + size * self.byte, n + size, used, b + size)
                else:
                    continue
                if found is None or new[0] > found[0]:
                    found = new
            at.append(found)
        return at[-1]

    def counted(self, words: Counter):
        used, n_bytes = Counter(), 0
        for w, n in words.items():
            _, _, pieces, b = self.best(w)
            for p in pieces:
                used[p] += n
            n_bytes += b * n
        total = sum(used.values()) + n_bytes + 0.5 * (len(self.scores) + 256)
        return Brute({p: math.log((used[p] + 0.5) / total) for p in self.scores}, math.log((n_bytes / 256 + 0.5) / total))


def words_of(t):
    return [R.MARK + w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def check(rows, docs, rounds=2):
    b = Brute(dict(zip(V.pieces, V.values.tolist(), strict=True)), V.byte)
    corpus = Counter(w for _, t in docs for w in words_of(t))
    for _ in range(rounds):
        b = b.counted(corpus)
    best = {w: b.best(w) for w in corpus}
    want = [(-1 if d is None else d, len(words_of(t)), sum(best[w][1] for w in words_of(t)), pytest.approx(sum(best[w][0] for w in words_of(t)), rel=1e-9)) for d, t in docs]
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_pretokens, r.n_tokens, r.score) for r in rows]
    assert sorted(got) == sorted(want, key=lambda x: x[:3])


@pytest.mark.parametrize("head", [R.HEAD, 50])
def test_query_against_brute_force(spark, sf, head, monkeypatch):
    monkeypatch.setattr(R, "HEAD", head)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op6_trie_tokens(spark, sf).collect(), docs)


def test_trie_shares_prefixes_and_takes_long_words():
    words = [R.MARK + w for w in ("a", "an", "and", "andes", "x" * 300, "ünïcödé", "\U0001f642\U0001f643", "日本語", "", "\u0000")]
    trie = R.Trie(V, words)
    assert sum(len(level[0]) for level in trie.levels) == 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})  # a node for each prefix
    b = Brute(dict(zip(V.pieces, V.values.tolist(), strict=True)), V.byte)
    for w, s, n in zip(words, *trie.terminals(), strict=True):
        assert (s, n) == (pytest.approx(b.best(w)[0]), b.best(w)[1])
    n = np.arange(1.0, len(words) + 1)
    counts, n_bytes = trie.used(n)
    want = Counter()
    for w, k in zip(words, n, strict=True):
        for p in b.best(w)[2]:
            want[p] += k
    assert {V.pieces[k]: c for k, c in enumerate(counts) if c} == want and n_bytes == sum(b.best(w)[3] * k for w, k in zip(words, n, strict=True))


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "word " * 30000), (5, "same"), (5, "same"), (None, "x y"), (6, "z" * 5000)]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n_tokens", "3 AS rid", "4 AS h1")
    check(R.count_tokens(docs).collect(), EDGES)
    assert R.count_tokens(docs.limit(0)).count() == 0
