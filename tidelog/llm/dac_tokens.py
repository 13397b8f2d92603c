"""Token ids on disk as directly addressable codes.

``write_tokens`` range-partitions documents by id, encodes every whole text with a ``tokenizers``
vocabulary, appends the end id to each document and writes the ids, in ascending document order, as
pages of a Parquet dataset (so any store that Spark can write will do).  A page payload is

    magic "DAC1" | u32 levels, u32 chunk bits (8), u64 documents, u64 tokens
    u64[documents + 1]  start of each document within the page
    i64[documents], u8[documents]  document ids, and whether they are null
    for each level: u64 n | n chunk bytes | ceil(n/8) continuation bits | u64[ceil(n/512)] ranks

Level 0 holds the low chunk of every id; a set continuation bit says that the next chunk stands on
the next level, at the rank of that bit.  The rank directory has the number of set bits before each
512-bit block, so ``Page.token(i)`` reads one chunk, one bit and one rank a level, whatever the page
holds; nothing is decoded around it.  A page holds whole documents of about ``PAGE_BYTES`` of text.

Document order is ascending id, null ids first; rows with one id are ordered by a hash of the text.
Ids are cast to longs; an id that is no number raises an error.  Null and empty texts are the end id
alone; a long text is one document of one page, however long.  Extra columns are ignored.  An empty table gives no
rows.  Texts are encoded piece by piece (see piece_starts), with the ids of pieces seen before at hand.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import _text as T

PAGE_BYTES = 2 << 20
MEMO = 1 << 20
BLOCK = 512
_BLANK, _LETTER, _PUNCTUATION = (np.zeros(256, bool) for _ in range(3))
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True
PAGES = "shard int, page int, shard_start long, first_row long, n_docs long, n_tokens long, payload binary"


def piece_starts(buf: np.ndarray, off: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Starts of pieces, at places where the pre-tokenizer splits whatever stands around them: texts,
    single spaces between non-blank characters, and ASCII punctuation after a letter.

    Blank characters are recognised by their UTF-8 bytes, on the safe side: an unsure place is no
    start, so a piece may hold several words but never a part of a pre-token.  Nor does a piece start
    within one of the strings of whole (a vocabulary's special tokens)."""
    n = len(buf)
    begin = np.zeros(n, bool)
    begin[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(buf[3 : n - 1] == 32) + 3
    c3, c2, c1, after = buf[at - 3], buf[at - 2], buf[at - 1], buf[at + 1]
    unsure = _BLANK[c1] | _BLANK[after] | (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    unsure |= (c2 == 0xC2) & ((c1 == 0x85) | (c1 == 0xA0))
    unsure |= (c3 >= 0xE1) & (c3 <= 0xE3) & (c2 >= 0x80) & (c1 >= 0x80)
    begin[at[~unsure]] = True
    at = np.flatnonzero(_PUNCTUATION[buf[2:]]) + 2
    c2, c1 = buf[at - 2], buf[at - 1]
    begin[at[_LETTER[c1] | ((c2 == 0xC3) & (c1 >= 0x80) & (c1 != 0x97) & (c1 != 0xB7))]] = True
    text = buf.tobytes() if whole else b""
    for special in whole:
        at = text.find(special)
        while at >= 0:
            begin[at + 1 : at + len(special)] &= np.isin(np.arange(at + 1, at + len(special)), off)
            at = text.find(special, at + 1)
    return np.flatnonzero(begin)


class Encoder:
    """tokenizers ids of whole texts.  Each distinct piece is encoded by the library once and then
    remembered (see Memo); once MEMO pieces are known, new ones are encoded but not kept."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.whole = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.memo = T.Memo(MEMO)
        self.starts, self.ids = np.zeros(MEMO + 1, np.int64), np.zeros(4 * MEMO, np.uint32)

    def _keep(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        at = self.memo.known
        room = int(np.searchsorted(np.cumsum(n), len(self.ids) - self.starts[at], side="right"))
        k = self.memo.add(h[:room], check[:room])
        self.starts[at + 1 : at + k + 1] = self.starts[at] + np.cumsum(n[:k])
        self.ids[self.starts[at] : self.starts[at + k]] = ids[: n[:k].sum()]

    def encode(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id after it; n+1 offsets)."""
        buf, off = T.text_buffer(col)
        starts = piece_starts(buf, off, self.whole)
        lens = np.diff(np.append(starts, len(buf)))
        h, check = T.Memo.keys_of(buf, starts, lens)
        entry = self.memo.find(h, check)
        new = np.flatnonzero(entry < 0)
        pick, back = T.distinct(h[new], check[new])
        own = new[pick]
        ids, n = [], []
        for at in range(0, len(own), 2000):
            texts = [buf[s : s + k].tobytes().decode() for s, k in zip(starts[own[at : at + 2000]], lens[own[at : at + 2000]], strict=True)]
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                got = e.ids
                ids += got
                n.append(len(got))
        ids, n = np.array(ids, np.uint32), np.array(n, np.int64)
        size = np.zeros(len(h), np.int64)
        old = entry >= 0
        size[old] = self.starts[entry[old] + 1] - self.starts[entry[old]]
        size[new] = n[back]
        upto = np.concatenate([[0], np.cumsum(size)])
        which = np.searchsorted(off, starts, side="right") - 1  # the text of each piece
        place = upto[:-1] + which  # one end id for each text before it
        out = np.full(int(upto[-1]) + len(off) - 1, end, np.uint32)
        out[T.spans_index(place[old], size[old])] = self.ids[T.spans_index(self.starts[entry[old]], size[old])]
        begin = np.cumsum(n) - n
        out[T.spans_index(place[new], size[new])] = ids[T.spans_index(begin[back], size[new])]
        self._keep(h[own], check[own], ids, n)
        return out, upto[np.searchsorted(starts, off)] + np.arange(len(off))


def pack(ids: np.ndarray, off: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A page of documents' ids."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64))])[:-1] if len(more) else np.zeros(0)
        levels.append(np.uint64(len(rest)).tobytes() + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ones.astype("<u8").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = b"DAC1" + np.array([len(levels), 8], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    return head + off.astype("<u8").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + b"".join(levels)


class Page:
    """A page read back: whole decoding, or any one token."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a DAC1 page")
        n_levels, bits = np.frombuffer(payload, "<u4", 2, 4)
        if bits != 8:
            raise ValueError(f"chunks of {bits} bits are not supported")
        docs, self.n_tokens = map(int, np.frombuffer(payload, "<u8", 2, 12))
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.offsets = take("<u8", docs + 1).astype(np.int64)
        values, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(v) for v, z in zip(values, null, strict=True)]
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // BLOCK))))

    def decode(self) -> np.ndarray:
        out = np.zeros(self.n_tokens, np.uint32)
        where = np.arange(self.n_tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out

    def token(self, i: int) -> int:
        """The i-th id of the page, by one chunk, bit and rank on each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, with what it has learned in earlier tasks."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _write(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, page, tokens, rows = encoder_of(vocabulary), 0, 0, 0
        for whole in batches:
            for b in T.slices(whole, "text", PAGE_BYTES):
                ids, off = encoder.encode(b.column("text"), end)
                out = {"shard": b.column("shard").slice(0, 1), "page": pa.array([page], pa.int32()), "shard_start": pa.array([tokens]), "first_row": pa.array([rows]), "n_docs": pa.array([b.num_rows]), "n_tokens": pa.array([len(ids)])}
                yield pa.RecordBatch.from_pydict(out | {"payload": pa.array([pack(ids, off, b.column("doc_id").to_pylist())], pa.binary())})
                page, tokens, rows = page + 1, tokens + len(ids), rows + b.num_rows

    return T.lean(run)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents as pages under path; shards are ranges of document ids."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    key = F.xxhash64(F.col("text"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id"), key).sortWithinPartitions("doc_id", key)
    ranged.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(_write(vocabulary, end), PAGES).write.mode("overwrite").parquet(path)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "shard_start", "payload")), strict=True):
                page = Page(payload)
                ids, off = page.decode().astype("<u4"), page.offsets
                out = {"doc_id": pa.array(page.doc_ids, pa.int64()), "shard": pa.array(np.full(len(off) - 1, shard, np.int32)), "at": pa.array(start + off[:-1]), "n_tokens": pa.array(np.diff(off))}
                out["ids_crc32"] = pa.array([zlib.crc32(ids[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)], pa.int64())
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return T.lean(run)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard (as many as the writer's range partitions): tokens of all shards before it."""
    from pyspark.sql import Window

    sizes = spark.read.schema(PAGES).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_at"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the pages: doc_id, start (ids of all documents before it), n_tokens, the
    crc32 of its ids as little-endian u32, and the ids themselves if asked for."""
    rows = spark.read.schema(PAGES).parquet(path).mapInArrow(_read(with_ids), "doc_id long, shard int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    found = rows.join(F.broadcast(shard_starts(spark, path)), "shard")
    return found.select("doc_id", (F.col("shard_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position of the whole stream: one page is read, and nothing of it is decoded."""
    shard = shard_starts(spark, path).filter(F.col("shard_at") <= position).orderBy(F.desc("shard_at"), F.desc("shard")).first()
    at = position - shard.shard_at if shard else position
    pages = spark.read.schema(PAGES).parquet(path).filter((F.col("shard") == (shard.shard if shard else -1)) & (F.col("shard_start") <= at) & (F.col("shard_start") + F.col("n_tokens") > at))
    row = pages.select("shard_start", "payload").first()
    if row is None:
        raise IndexError(position)
    return Page(bytes(row.payload)).token(at - row.shard_start)
