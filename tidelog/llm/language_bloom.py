"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter is one array of SLOTS bit masks, one bit for each language: a language's
Bloom filter is its bit in every slot.  An n-gram reads HASHES slots; the AND of their masks is the
set of all languages that (may) contain it.  For a text, the popcount of each language's bit over all
n-grams, corrected for the false positives that the language's share of set bits lets through,
decides.

Learning: n-grams (2 to 4 characters of letters and single spaces, lower case, words padded by a
space) of labelled documents.  The labelled rows are a bounded sample: about ``per_language`` whole
documents of each language (all, where there are fewer), taken by a hash of id and text; with
``whole`` they are all rows.  An n-gram is put into a language's filter if at least ``min_docs`` of these
documents of the language hold it (of more than ``per_language``: as many for each ``per_language``, so
filters don't fill with the corpus) and its share of them is at least ``min_share`` of its largest share in
any language, so foreign passages do not spoil a filter.  Only fixed-size filters reach the driver.

Prediction reads the whole text, of any length, and nothing else.  Rows are judged one by one, whatever
their ids; extra columns are ignored; an empty table gives no rows.  ``und`` (score 0) for null texts and texts without
a letter.  The score is the winner's share of the corrected counts of the best two.  Ties go to the
language with more learning rows, then by name.  If no n-gram is known, the most frequent language is
predicted with score 0; without learned languages every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T

SLOTS, HASHES, ORDERS = 1 << 21, 3, (2, 3, 4)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of all texts, the text of each, and whether each text has a letter.

    A 0 stands before and after each text, one space (32) for each run of other characters."""
    low = [(t or "").lower() for t in texts]
    x = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "replace"), "<u4").copy()
    ends = np.cumsum([0] + [len(t) + 1 for t in low])
    sep = np.zeros(len(x), bool)
    sep[ends] = True
    letter = letters()[x]
    letter[ends] = False
    x[~letter] = 32
    x[sep] = 0
    keep = letter | sep
    keep[1:] |= letter[:-1]
    text = np.cumsum(sep) - 1
    some = np.bincount(text[letter], minlength=len(low))[: len(low)] > 0
    x, text = x[keep], text[keep]
    before = np.flatnonzero((x[:-1] == 0) & (x[1:] > 0)) + 1
    after = np.flatnonzero((x[:-1] != 0) & (x[:-1] != 32) & (x[1:] == 0)) + 1
    at = np.concatenate([before, after])
    return np.insert(x, at, 32), np.insert(text, at, text[np.concatenate([before, after - 1])]), some


def ngrams(x: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text of each) for each order; none crosses a text's end."""
    codes = x.astype(T.U64)
    for n in ORDERS:
        if len(x) < n:
            continue
        h = codes[: len(x) - n + 1].copy()
        whole = x[: len(x) - n + 1] > 0
        for k in range(1, n):
            part = codes[k : len(x) - n + 1 + k]
            h = _joined(h, part, k)
            whole &= part > 0
        h = T.mix(h[whole] ^ T.U64(n << 60))
        yield h, text[: len(x) - n + 1][whole]


def _joined(h: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """k characters and the next one."""
    return (h * T.U64(0x100000001B3)) ^ part if k > 2 else h | (part << T.U64(21 * k))


def holders(texts: list[str | None], lang: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, hashes of n-grams, number of the language's texts with the n-gram), each pair once for each order."""
    by = np.argsort(lang, kind="stable")
    lang = lang[by]
    x, text, _ = characters([texts[k] for k in by.tolist()])
    used = np.zeros(0x110000, bool)
    used[x] = True
    alphabet, most = np.flatnonzero(used).astype(T.U64), max(ORDERS)
    bits, low = T.U64(max(1, int(len(alphabet) - 1).bit_length())), T.U64(int(len(lang) - 1).bit_length())
    own = lambda key: (key & ((T.U64(1) << low) - T.U64(1))).astype(np.int64)
    if most * int(bits) + int(low) > 64:  # too many for one number
        for h, of in ngrams(x, text):
            one, _ = T.distinct(h, of.astype(T.U64))
            for k in np.unique(lang[of[one]]):
                u, n = np.unique(h[one[lang[of[one]] == k]], return_counts=True)
                yield np.full(len(u), k), u, n
        return
    rank = np.cumsum(used) - 1
    code = np.concatenate([rank[x], np.zeros(most - 1, np.int64)]).astype(T.U64)
    key, inside = code[: len(x)].copy(), x > 0
    for k in range(1, most):  # the longest n-gram at each character, cut at the text's end
        part = code[k : len(x) + k]
        inside &= part > 0
        key = (key << bits) | (part * inside)
    key = ((key << low) | text.astype(T.U64))[x > 0]
    for n in range(most, 1, -1):  # sorted by n-gram and text; a shorter n-gram is the start of a longer one
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        full = key[(key >> low) & ((T.U64(1) << bits) - T.U64(1)) > 0]
        if n in ORDERS and len(full):
            gram, of = full >> low, lang[own(full)]
            at = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])))
            parts = [alphabet[((gram[at] >> (bits * T.U64(n - 1 - k))) & ((T.U64(1) << bits) - T.U64(1))).astype(np.int64)] for k in range(n)]
            h = parts[0]
            for k in range(1, n):
                h = _joined(h, parts[k], k)
            yield of[at], T.mix(h ^ T.U64(n << 60)), np.diff(np.append(at, len(full)))
        key = ((key >> (low + bits)) << low) | (key & ((T.U64(1) << low) - T.U64(1)))


def slots(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h >> T.U64(21 * k)) & T.U64(SLOTS - 1)).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]  # by falling number of learning rows
    masks: np.ndarray  # (words of 64 languages, SLOTS)

    def __post_init__(self):
        n = len(self.languages)
        fill = np.array([np.mean((self.masks[k // 64] >> T.U64(k % 64)) & T.U64(1)) for k in range(n)])
        self.false = fill**HASHES

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected n-gram counts (texts, languages), n-grams of each text, has a letter."""
        x, text, some = characters(texts)
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for h, own in ngrams(x, text):
            first = np.searchsorted(own, np.arange(len(texts) + 1))
            total += np.diff(first)
            all_of = np.full((len(self.masks), len(h)), ~T.U64(0))
            for s in slots(h):
                all_of &= self.masks[:, s]
            for k in range(len(self.languages)):
                hits[:, k] += T.per_text((all_of[k // 64] >> T.U64(k % 64)).astype(np.uint8) & 1, first)
        return np.maximum(0, (hits - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9)), total, some

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, _, some = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = counts.argmax(axis=1)
        top = np.sort(np.pad(counts, ((0, 0), (1, 0))), axis=1)
        both = top[:, -1] + top[:, -2]
        score = np.where(some & (both > 0), top[:, -1] / np.maximum(both, 1e-300), 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some, strict=True)], score


def _collect_ngrams(languages: list[str]):
    at = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [T.Counter(max(20_000, 2_000_000 // len(languages))) for _ in languages]

        def out(lang, counted):
            h, n = counted or ((), ())
            for k in range(0, len(h), 1 << 16):
                m = len(h[k : k + (1 << 16)])
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(m, lang, np.int32)), "h": pa.array(h[k : k + m].view(np.int64)), "n": pa.array(n[k : k + m].astype(np.int64))})

        for whole in batches:
            for b in T.slices(whole, "text", 1 << 20):
                for lang, h, n in holders(b.column("text").to_pylist(), np.array([at[name] for name in b.column("lang").to_pylist()])):
                    for k in np.unique(lang).tolist():
                        yield from out(k, seen[k].put(h[lang == k], n[lang == k]))
        for k, counter in enumerate(seen):
            yield from out(k, counter.rest())

    return T.lean(run)


def learn(docs: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000, min_docs: int = 2, min_share: float = 0.1, whole: bool = False) -> Filters:
    """Filters of all languages of the rows where the column learn_from is true; with whole, of every such row."""
    rows = docs.filter(learn_from).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(size, key=lambda k: (-size[k], k))
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((words, SLOTS), T.U64)
    if languages:
        unit = 1 << 30
        share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(unit, int(unit * per_language / size[k]) + 1))))
        sample = rows if whole else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(unit)) < share[F.col("lang")])
        found = sample.select("text", "lang").mapInArrow(_collect_ngrams(languages), "lang int, h long, n long")
        taught = [float(size[name] if whole else min(size[name], per_language)) for name in languages]
        docs_of = F.create_map(*(F.lit(x) for k, n in enumerate(taught) for x in (k, n)))
        least = F.create_map(*(F.lit(x) for k, n in enumerate(taught) for x in (k, min_docs * max(1.0, n / per_language))))
        by_lang = found.groupBy("h", "lang").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / docs_of[F.col("lang")])
        held = by_lang.groupBy("h").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "n", "share")).alias("of"))  # one entry per language
        kept = held.select("h", "most", F.explode("of").alias("o")).filter((F.col("o.n") >= least[F.col("o.lang")]) & (F.col("o.share") >= min_share * F.col("most")))
        word, bit = F.floor(F.col("o.lang") / 64), F.expr("shiftleft(1L, o.lang % 64)")
        slot = F.explode(F.array(*(F.shiftrightunsigned("h", 21 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)))).alias("slot")
        bits = kept.select(word.cast("short").alias("word"), bit.alias("bit"), slot).groupBy("word", F.col("slot").cast("int").alias("slot")).agg(F.bit_or("bit").alias("bits")).toArrow()
        masks[bits["word"].to_numpy().astype(np.int64), bits["slot"].to_numpy()] = bits["bits"].to_numpy().view(T.U64)
        del bits
    T.give_back()
    return Filters(languages, masks)


def _predict(filters, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, text, 1 << 20):
                lang, score = filters.value.predict(b.column(text).to_pylist())
                out = {c: b.column(c) for c in b.schema.names if c != text}
                yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return T.lean(run)


def identify(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from the whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(filters), "text"), f"doc_id {kind}, lang_pred string, score double")
