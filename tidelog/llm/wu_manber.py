"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (the whole item, where it
has fewer words).  For patterns of one length m the searcher keeps the three classic tables: a shift
table over blocks of two words (how far the window may jump when it ends in that block), suffix-hash
buckets that list the patterns that end in a block, and the patterns themselves for the direct
comparison that confirms an occurrence (first the word hashes, then the bytes of every word).  The
words of the items are kept once; a pattern is the place of its first word.

Texts are scanned in lanes: each lane is a cursor over up to LANE window ends of one text, and one
numpy step moves all cursors of a batch by their shifts.  Documents are never shuffled.  The
benchmark is cut into blocks whose tables take at most ``table_bytes`` (an item is not divided), and
one block is broadcast at a time.  Several blocks make several passes, each of which writes only the
rows (narrow, without texts) of documents with hits; they are merged by two hashes of id and text.

Words are maximal runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII characters.
Null or wordless texts have no words, no hits and no items; texts of any length are searched to
their end.  Benchmark rows without words match nothing; an item whose id is null marks words but is
not listed.  Repeated item rows count once.  Repeated documents are judged row by row.  An empty
documents table gives no rows; an empty benchmark hits nothing.  Extra columns are ignored by
``passages`` and kept as they are by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm._scratch import written

LANE = 512
SPANS = "items array<string>, span_starts array<int>, span_ends array<int>"
#: Bytes of tables for a word of the benchmark, at most; its text comes on top.
PER_WORD = 64
#: Distinct blocks are counted by this many bits of their hashes, so a shift table has at most 2 ** (MOST_SLOTS + 2) entries.
MOST_SLOTS = 24


class Tables:
    """Wu-Manber tables for the patterns of m words that start at the words ``at`` of a block."""

    def __init__(self, words: tuple[np.ndarray, ...], at: np.ndarray, m: int):
        self.h, self.buf, self.starts, self.lens = words
        self.m, self.block = m, min(2, m)
        places = range(self.block - 1, m)
        seen = np.zeros(1 << MOST_SLOTS, bool)
        for end in places:
            seen[(self._key(self.h, at + end) & T.U64(len(seen) - 1)).astype(np.int64)] = True
        bits = max(8, int(np.ceil(np.log2(4 * int(seen.sum()) + 1))))
        del seen
        self.mask = T.U64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8 if m < 256 else np.int32)
        for end in places:
            slot = (self._key(self.h, at + end) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, np.array(m - 1 - end, self.shift.dtype))
        bits = max(8, int(np.ceil(np.log2(2 * len(at) + 1))))
        self.last = T.U64((1 << bits) - 1)
        last = (self._key(self.h, at + m - 1) & self.last).astype(np.int32)
        order = np.argsort(last, kind="stable")
        self.at = at[order].astype(np.int32)
        self.bucket = np.searchsorted(last[order], np.arange((1 << bits) + 1)).astype(np.int32)
        self.order = order

    def _key(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each word."""
        x = h[end] if self.block == 1 else (h[end - 1] * T.U64(0x9E3779B97F4A7C15)) ^ h[end]
        return x ^ (x >> T.U64(31))

    @property
    def nbytes(self) -> int:
        return self.shift.nbytes + self.at.nbytes + self.bucket.nbytes

    def search(self, h: np.ndarray, first: np.ndarray, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence within a text."""
        lo, hi = first[:-1] + self.m - 1, first[1:]
        n = np.maximum(0, -(-(hi - lo) // LANE))
        at = np.repeat(lo, n) + LANE * T.spans_index(np.zeros_like(n), n)
        stop = np.minimum(at + LANE, np.repeat(hi, n))
        found = []
        while len(at):
            s = self.shift[(self._key(h, at) & self.mask).astype(np.int64)].astype(np.int64)
            found.append(at[s == 0])
            at = at + np.maximum(s, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        end = np.concatenate(found) if found else np.zeros(0, np.int64)
        slot = (self._key(h, end) & self.last).astype(np.int64)
        size = (self.bucket[slot + 1] - self.bucket[slot]).astype(np.int64)
        pattern = T.spans_index(self.bucket[slot].astype(np.int64), size)
        end = np.repeat(end, size)
        for k in range(self.m):  # the first word decides most candidates
            same = h[end - self.m + 1 + k] == self.h[self.at[pattern] + k]
            end, pattern = end[same], pattern[same]
        for k in range(self.m):
            same = _same_words(buf, starts, lens, end - self.m + 1 + k, self.buf, self.starts, self.lens, self.at[pattern] + k)
            end, pattern = end[same], pattern[same]
        return end, pattern


def _same_words(buf, starts, lens, a, buf2, starts2, lens2, b) -> np.ndarray:
    """Whether the words a of one buffer have the bytes of the words b of another."""
    ok = lens[a] == lens2[b]
    length = np.where(ok, lens[a], 0).astype(np.int64)
    equal = buf[T.spans_index(starts[a], length)] == buf2[T.spans_index(starts2[b].astype(np.int64), length)]
    return ok & (T.per_text(~equal, np.concatenate([[0], np.cumsum(length)])) == 0)


@dataclass
class Block:
    """Tables of one block of benchmark items, one for each pattern length, and whose patterns they are."""

    tables: list[Tables]
    owner_first: list[np.ndarray]  # for each pattern of each table: its first owner
    owners: list[np.ndarray]  # places in names
    names: list[str]

    @property
    def nbytes(self) -> int:
        words = sum(x.nbytes for x in (self.tables[0].h, self.tables[0].buf, self.tables[0].starts, self.tables[0].lens)) if self.tables else 0
        return words + sum(t.nbytes for t in self.tables) + sum(x.nbytes for x in (*self.owner_first, *self.owners))


def build(ids: pa.Array, texts: pa.Array, window: int = 10) -> Block:
    """The tables of benchmark items."""
    h, first, buf, starts, lens = T.words_of(texts, T.ALNUM_WORD)
    words = h, buf, starts.astype(np.int32 if len(buf) < 1 << 31 else np.int64), lens.astype(np.int32)
    n = np.diff(first)
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    coded = ids.dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = Block([], [], [], coded.dictionary.to_pylist())
    for m in np.unique(np.minimum(n, window)).tolist():
        if not m:
            continue
        own = np.flatnonzero(np.minimum(n, window) == m)
        count = n[own] - m + 1
        at, item = T.spans_index(first[:-1][own], count), np.repeat(code[own], count)
        key = T.hash_ngrams(h, m)[at]
        order = np.argsort(key, kind="stable")
        key, at, item = key[order], at[order], item[order]
        new = np.append(True, key[1:] != key[:-1])
        lead = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        for k in range(m):  # windows of one hash and other words are patterns of their own
            for lo in range(0, len(at), 1 << 18):
                some = slice(lo, lo + (1 << 18))
                new[some] |= ~_same_words(buf, starts, lens, at[some] + k, buf, starts, lens, lead[some] + k)
        pattern = np.cumsum(new) - 1
        table = Tables(words, at[new], m)
        place = np.empty(len(table.order), np.int64)  # of each pattern in the buckets
        place[table.order] = np.arange(len(place))
        del table.order
        pairs = np.unique((place[pattern[item >= 0]] << 32) | item[item >= 0])
        out.tables.append(table)
        out.owner_first.append(np.searchsorted(pairs >> 32, np.arange(len(place) + 1)).astype(np.int32))
        out.owners.append((pairs & 0xFFFFFFFF).astype(np.int32))
    return out


def scan(col: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, hit flag of each word, pairs (text, place of an item in names), words
    hit of each text)."""
    h, first, buf, starts, lens = T.words_of(col, T.ALNUM_WORD)
    edge = np.zeros(len(h) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for t, owner_first, owners in zip(block.tables, block.owner_first, block.owners, strict=True):
        end, pattern = t.search(h, first, buf, starts, lens)
        np.add.at(edge, end - t.m + 1, 1)
        np.add.at(edge, end + 1, -1)
        doc = np.searchsorted(first, end, side="right") - 1
        seen = np.unique((doc << 32) | pattern)
        doc, pattern = seen >> 32, seen & 0xFFFFFFFF
        n = (owner_first[pattern + 1] - owner_first[pattern]).astype(np.int64)
        pairs.append((np.repeat(doc, n) << 32) | owners[T.spans_index(owner_first[pattern].astype(np.int64), n)])
    hit = np.cumsum(edge[:-1]) > 0
    pairs = np.unique(np.concatenate(pairs))
    return first, hit, np.stack([pairs >> 32, pairs & 0xFFFFFFFF]), T.per_text(hit, first)


def _report(block, keep: list[str], all_rows: bool):
    """Mapper of rows with a text to the columns keep, n_words, n_hit and SPANS; of documents with hits only,
    unless all_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = block.value.names
        for whole in batches:
            for b in T.slices(whole, "text"):
                first, hit, pairs, n_hit = scan(b.column("text"), block.value)
                cut = np.searchsorted(pairs[0], np.arange(len(first)))
                # runs of hit words never cross texts
                padded = np.zeros(len(hit) + len(first) + 1, np.int8)
                padded[1 + T.spans_index(first[:-1] + np.arange(len(first) - 1), np.diff(first))] = hit
                flips = np.diff(padded)
                begin, end = np.flatnonzero(flips > 0), np.flatnonzero(flips < 0)
                origin = first + np.arange(len(first))
                text = np.searchsorted(origin, begin, side="right") - 1
                spans = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
                own = [sorted(names[k] for k in pairs[1][a:e]) for a, e in pairwise(cut.tolist())]
                out = {c: b.column(c) for c in keep} | {
                    "n_words": pa.array(np.diff(first)), "n_hit": pa.array(n_hit), "items": pa.array(own, pa.list_(pa.string())),
                    "span_starts": lists(spans, pa.array((begin - origin[text]).astype(np.int32))), "span_ends": lists(spans, pa.array((end - origin[text]).astype(np.int32))),
                }
                made = pa.RecordBatch.from_pydict(out)
                yield made if all_rows else made.filter(pa.array(n_hit > 0))

    return T.lean(run)


def _clean(block, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, text):
                yield b.filter(pa.array(scan(b.column(text), block.value)[3] == 0))

    return T.lean(run)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, table_bytes: int) -> tuple[int, Iterator]:
    """(number of blocks, an iterator over their broadcast tables, each built when it is asked for)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    size = items.agg(F.sum(F.octet_length("t")).alias("b"), F.sum(F.regexp_count(F.lower("t"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("w")).first()
    n = max(1, -(-((size.b or 0) + PER_WORD * (size.w or 0)) // table_bytes))

    def each():
        for k in range(n):
            part = (items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).toArrow()
            yield benchmark.sparkSession.sparkContext.broadcast(build(part["i"], part["t"], window))
            T.give_back()

    return n, each()


KEYS = ("__text_hash_1", "__text_hash_2")


def _keyed(text: str) -> list:
    """Two hashes of the text: rows that share them share their result."""
    return [F.xxhash64(F.lit(k), F.col(text)).alias(key) for k, key in enumerate(KEYS)]


def _hits(docs: DataFrame, text: str, blocks: Iterator) -> DataFrame:
    """KEYS, n_words, n_hit and SPANS of texts with hits, a row for each block with hits."""
    rows, out = docs.select(*_keyed(text), F.col(text).alias("text")), None
    for block in blocks:
        part = written(rows.mapInArrow(_report(block, list(KEYS), False), f"{KEYS[0]} long, {KEYS[1]} long, n_words long, n_hit long, {SPANS}"), "hits")
        block.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _merged(parts: DataFrame) -> DataFrame:
    """One row per text: the items and spans of all blocks."""
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends")))).alias("spans")
    met = parts.dropDuplicates([*KEYS, "items", "span_starts", "span_ends"]).groupBy(*KEYS).agg(items, spans)
    start = F.array().cast("array<struct<span_starts:int,span_ends:int>>")

    def step(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["span_starts"].alias("span_starts"), F.greatest(last["span_ends"], s["span_ends"]).alias("span_ends"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["span_ends"] >= s["span_starts"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    met = met.withColumn("spans", F.aggregate("spans", start, step))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["span_ends"] - s["span_starts"])
    return met.select(*KEYS, "items", n_hit.alias("n_hit"), F.col("spans.span_starts").alias("span_starts"), F.col("spans.span_ends").alias("span_ends"))


def passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, table_bytes: int = 128 << 20) -> DataFrame:
    """One row per document row: its id as doc_id, n_words, n_hit, the ids of items with an occurring
    window (strings, sorted) and the maximal runs of hit words as span_starts / span_ends."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n, blocks = _blocks(benchmark, item_id, item_text, window, table_bytes)
    if n == 1:
        return rows.mapInArrow(_report(next(blocks), ["doc_id"], True), f"doc_id {kind}, n_words long, n_hit long, {SPANS}")
    found = _merged(_hits(rows, "text", blocks))
    size = F.regexp_count(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    all_rows = written(rows.select("doc_id", *_keyed("text"), size.alias("n_words")), "sizes")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return all_rows.join(found, list(KEYS), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), none("items", "array<string>"), none("span_starts", "array<int>"), none("span_ends", "array<int>"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, table_bytes: int = 128 << 20) -> DataFrame:
    """The rows of docs, all columns kept, in which no window of the benchmark occurs."""
    n, blocks = _blocks(benchmark, item_id, item_text, window, table_bytes)
    if n == 1:
        return docs.mapInArrow(_clean(next(blocks), text), docs.schema)
    gone = written(_hits(docs, text, blocks).select(*KEYS).distinct(), "gone")
    return docs.select("*", *_keyed(text)).join(gone, list(KEYS), "left_anti").select(*docs.columns)
