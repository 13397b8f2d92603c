import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm import dac_tokens as D
from tidelog.llm.queries import op10_dac_tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(docs):
    at, out = 0, []
    for d, t in docs:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    return out


def test_query_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op10_dac_tokens(spark, sf).collect())
    assert got == want([tuple(r) for r in docs])


ODD = ["", None, " ", "  two  spaces ", "a  b 　c", "x \n y\n z", "tab\t t", "it's  we'll 12 345", "  a \x1c b", "é è ê — “q” ", "<|endoftext|> a <|endoftext|>", "a" * 3000, " ".join(["word"] * 4000), "🙂 🙃🙂", "end ", " begin"]


def test_odd_texts_round_trip(spark, tmp_path):
    docs = [(k * 3 - 5, t) for k, t in enumerate(ODD)] + [(10**12, "last one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS ids").repartition(3)
    path = f"file://{tmp_path}/t"
    D.write_tokens(df, path)
    rows = sorted(D.read_tokens(spark, path, with_ids=True).collect())
    assert [tuple(r)[:4] for r in rows] == want(docs)
    stream = [i for r in rows for i in r["ids"]]
    for at in [0, 1, 5, len(stream) // 2, len(stream) - 1]:
        assert D.token_at(spark, path, at) == stream[at]
    with pytest.raises(IndexError):
        D.token_at(spark, path, len(stream))


def test_nulls_ties_and_empty(spark, tmp_path):
    docs = [(None, "a b"), (7, "x"), (7, "x"), (7, "other text"), (1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    D.write_tokens(df, f"file://{tmp_path}/t")
    rows = D.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 7, 7, 7]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    D.write_tokens(df.limit(0), f"file://{tmp_path}/e")
    assert D.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_random_access_on_every_level():
    rng = np.random.default_rng(1)
    ids = (2 ** rng.uniform(0, 32, 5000)).astype(np.uint32)
    page = D.Page(D.pack(ids, np.array([0, 2000, 5000]), [4, None]))
    assert page.decode().tolist() == ids.tolist() and page.doc_ids == [4, None]
    assert [page.token(i) for i in range(5000)] == ids.tolist()
    with pytest.raises(ValueError):
        D.Page(b"nope" + bytes(40))
