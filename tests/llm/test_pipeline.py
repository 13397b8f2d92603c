import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_fair_mix import brute as brute_mix
from tests.llm.test_hamming_dedup import brute as brute_classes
from tests.llm.test_wu_manber import brute as brute_passages
from tidelog.llm import toxicity_cnn


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = [n for n, _ in P.STAGES], {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]

    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    clean = kept["toxicity"]
    gone = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} - {r.doc_id for r in clean}
    assert len(gone & toxic) >= 0.8 * len(toxic) > 0 and len(gone - toxic) <= len(toxic) + 5
    pairs = [(r.doc_id, r.text) for r in clean]
    assert {r.doc_id for r in kept["near_duplicates"]} == {c for _, _, c in brute_classes(pairs, 5)}

    pairs = [(r.doc_id, r.text) for r in kept["near_duplicates"]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept["decontamination"]} == {d for d, (_, hit, _) in brute_passages(pairs, items).items() if not hit}

    rows = [(r.doc_id, r.text, r.source, r.n_chars) for r in kept["decontamination"]]
    taken = {d: t for d, _, _, _, t in brute_mix(rows, None)}
    got = {}
    for r in kept["mixing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {d: t for d, t in taken.items() if t}

    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(kept["tokens"], key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for r in kept["mixing"]:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4"))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in kept["tokens"]) == sorted(want)
    assert [r.doc_id for r in sorted(kept["tokens"], key=lambda r: r.start)] == sorted(r.doc_id for r in kept["mixing"])


def test_toxicity_against_scores_text_by_text(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    net = toxicity_cnn.learn(docs, spark.read.parquet(f"{big}/labels.parquet"), lambda _: F.lit(True))
    want = {r.doc_id for r in docs.collect() if net.scores(pa.array([r.text]))[0] < 0.5}
    got = {r.doc_id for r in P.toxicity(spark, docs, big).collect()}
    assert got == want and len(want) < docs.count()


EDGES = [
    (1, None, "a", "web", 0), (2, "", "a", "web", 0), (3, " \n", None, None, 2), (4, "long " * 200_000, "b", "web", 1_000_000), (5, "Same text here", "a", "news", 14), (5, "Same text here", "a", "news", 14),
    (5, "same id other text", "a", "news", 18), (None, "null id text", "a", "news", 12), (None, "same null text", "a", None, 14), (None, "same null text", "a", None, 14), (6, "one two three four five six seven eight nine ten eleven", "a", "web", 53), (7, "the answer is tiny", "b", "books", 18),
]


@pytest.fixture
def edges(spark, tmp_path):
    spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", "One two three four five six seven eight nine ten"), (None, None), ("b", " ")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS row", "3 AS score", "4 AS n_hit")
    return docs, str(tmp_path)


def test_edges_of_each_stage(spark, edges):
    docs, sf_dir = edges
    out = {name: stage(spark, docs, sf_dir) for name, stage in P.STAGES}
    assert all(out[n].columns == docs.columns for n in out if n != "tokens")
    rows = {n: [r.asDict() for r in out[n].collect()] for n in out}
    ids = lambda n: sorted((r["doc_id"] or 0) for r in rows[n])
    assert set(ids("toxicity")) <= {0, *range(1, 8)} and 7 in ids("toxicity")
    assert ids("near_duplicates") == [0, 0, 1, 2, 3, 4, 5, 5, 6, 7]  # one of each two equal rows
    assert ids("decontamination") == [0, 0, 0, 1, 2, 3, 4, 5, 5, 5, 7]
    words = sum(len((t or "").split()) for _, t, *_ in EDGES)
    assert sum(len(r["text"].split()) for r in rows["mixing"]) == int(1.5 * words) and not {1, 2, 3} & set(ids("mixing"))
    assert len(rows["tokens"]) == len(EDGES) and all(r["n_tokens"] >= 1 for r in rows["tokens"])
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_run_gives_the_last_stage(spark, sf):
    rows = P.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 100


def test_the_toxicity_stage_learns_from_every_labelled_document(spark, tmp_path, monkeypatch):
    """Before: thresholds came from a fifth of a sample, here of about 80 documents."""
    rng = np.random.default_rng(9)
    plain = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join([*rng.choice(plain, 6), f"vile{rng.integers(0, 60)}" if k % 3 == 0 else "mild"]), "a", "s", 1) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(3000)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, best, learn = [], toxicity_cnn.best_logit, toxicity_cnn.learn
    monkeypatch.setattr(toxicity_cnn, "best_logit", lambda z, y, *n: seen.append(int(n[0].sum()) if n else len(y)) or best(z, y, *n))
    monkeypatch.setattr(toxicity_cnn, "learn", lambda *args: learn(*args, per_class=40))
    left = {r.doc_id for r in dict(P.STAGES)["toxicity"](spark, df, str(tmp_path)).collect()}
    assert max(seen) > 500
    assert sum((k in left) == (k % 3 > 0) for k in range(3000)) > 0.97 * 3000


def test_toxicity_learns_languages_from_every_document(spark, tmp_path, monkeypatch):
    """Before: the filters that choose a text's threshold came from about 2000 documents of each language."""
    word = lambda k: "".join(chr(0x4E00 + 4 * k + j) for j in range(4))
    texts = [word(k) for k in range(30) for _ in range(6)] + [word(k) for k in range(30, 60) for _ in range(5)]
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts + ["good day"] * (6000 - len(texts)))], "doc_id long, text string, lang string")
    spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    nets = []
    monkeypatch.setattr(toxicity_cnn, "keep_clean", lambda docs, net: nets.append(net) or docs)
    P.toxicity(spark, docs, str(tmp_path))
    counts, total, _ = nets[0].languages.counts([word(k) for k in range(60)])
    assert np.allclose(counts[:30, 0], total[:30], atol=0.1)  # 6 of 6000 documents: as many as 2 of 2000
    assert np.allclose(counts[30:, 0], 0, atol=0.1)
