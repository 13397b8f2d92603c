"""Exact removal of repeated passages with suffix arrays built by two-stage sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in a document
with a smaller id, or earlier in the same document.  Strings never cross documents.

No suffix array can hold the corpus, so strings that may be equal are brought together first:

1.  Every window of ``length`` bytes has a minimizer, the least hash of its grams of GRAM bytes
    (leftmost among equals).  Equal windows have equal minimizers at equal offsets.  Consecutive
    windows with one minimizer form a stretch, about 35 windows that share most of their bytes.
2.  Minimizers are counted over all documents.  A Bloom filter of those that occur twice or more (its
    size follows their number, up to 2**MOST_BITS bits; a fuller filter only lets more through)
    picks the stretches that can hold a repeated window.
3.  Stretches of equal content are pre-aggregated: the first one stands for all, the others are
    covered by it from end to end.  So copies, however many, never meet in one task.
4.  First stretches whose minimizer has other contents too are gathered by minimizer.  Where a
    minimizer has more than CROWD contents (the edges of a popular passage), its stretches are cut
    into PARTS by the offset of the minimizer and gathered by all bytes that a part's windows share,
    after which step 3 is repeated; what still differs are the few bytes at the ends.  Parts of which
    there are more than CROWD even then are taken apart into their windows, a few each, of which equal
    ones (by 128 hash bits) are pre-aggregated.  So no group of step 5 has more than CROWD contents.
5.  A task sorts the suffixes of its stretches (two-stage sort below), and adjacent common prefixes
    of at least ``length`` bytes form classes of equal windows; all but the earliest of each class
    are removed.

Two-stage sort: suffixes smaller than their successor are sorted directly; the others are induced by
scanning the buckets of first bytes from the smallest on, each scanned suffix placing its
predecessor at the next free place of its bucket (whole buckets at a time, and runs of one byte in
rounds).  Sorting stops at ``length`` bytes, as no later byte matters.

Null texts are empty; texts of any length are taken whole, CHUNK bytes at a time; texts shorter than ``length`` keep all bytes.  Null ids come before all others.
Ids are cast to longs; an id that is no number raises an error.  Rows with one id are documents ordered by a hash of the text; rows with equal id and text are one
document and share their fate.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm._bloom import bloom, has, spark_xxhash64
from tidelog.llm._scratch import written

GRAM, CROWD, PARTS = 32, 256, 16
CHUNK = 1 << 20  # bytes whose windows are handled together
SA_BYTES = 1 << 20


def stretches(buf: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start in buf, windows, minimizer position in buf, and its hash) of all stretches, in pieces."""
    for at in range(0, max(1, len(buf) - length + 1), CHUNK - length):
        part = buf[at : at + CHUNK]
        n = len(part) - length + 1
        if n <= 0:
            return
        blocks = T._blocks(part)
        m = len(part) - GRAM + 1
        h = np.full(m, GRAM, T.U64)
        for k in range(0, GRAM, 8):
            h = (h ^ blocks[k : k + m]) * T._MUL
            h ^= h >> T.U64(29)
        h = h * T._MUL2
        h ^= h >> T.U64(32)
        low = (h & ~T.U64(CHUNK - 1)) | np.arange(m, dtype=T.U64)
        grams, have = length - GRAM + 1, 1
        while 2 * have <= grams:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < grams:
            low = np.minimum(low[: -(grams - have)], low[grams - have :])
        low = (low[:n] & T.U64(CHUNK - 1)).astype(np.int64)
        n = min(n, CHUNK - length)  # the windows from there on belong to the next piece
        start = at + np.arange(n)
        text = np.searchsorted(off, start, side="right") - 1
        good = start + length <= off[text + 1]
        start, text, low = start[good], text[good], low[:n][good]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        yield text[first], start[first], np.diff(np.append(first, len(start))), at + low[first], h[low[first]]


def _count(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = T.Counter()

        def give(found):
            if found is not None:
                for at in range(0, len(found[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(found[0][at : at + (1 << 17)].view(np.int64)), pa.array(found[1][at : at + (1 << 17)])], ["mh", "n"])

        for whole in batches:
            for b in T.slices(whole, "text", CHUNK):
                for *_, h in stretches(*T.text_buffer(b.column("text")), length):
                    yield from give(counter.add(h))
        yield from give(counter.rest())

    return T.lean(run)


def _emit(length: int, passing, with_bytes: bool):
    """Stretches that pass both filters: of minimizers (by mh) and, if given, of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimizers, places = passing.value
        for whole in batches:
            for b in T.slices(whole, "text", CHUNK):
                buf, off = T.text_buffer(b.column("text"))
                d, th = b.column("d").to_numpy(), b.column("th").to_numpy()
                for text, start, n, low, h in stretches(buf, off, length):
                    pos = start - off[text]
                    ok = has(minimizers, h.view(np.int64))
                    if places is not None:
                        ok &= has(places, spark_xxhash64(d[text], th[text], pos))
                    text, start, n, low, h, pos = (x[ok] for x in (text, start, n, low, h, pos))
                    size = n + length - 1
                    out = {"mh": pa.array(h.view(np.int64)), "d": pa.array(d[text]), "th": pa.array(th[text]), "pos": pa.array(pos), "n": pa.array(n)}
                    if with_bytes:
                        out["back"] = pa.array(low - start)
                        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                        out["bytes"] = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut), pa.py_buffer(buf[T.spans_index(start, size)])])
                    else:
                        out |= {f"c{k}": pa.array(T.hash_spans(buf, start, size, seed=k).view(np.int64)) for k in (1, 2)}
                    if len(n):
                        yield pa.RecordBatch.from_pydict(out)

    return T.lean(run)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (symbols from 1 to 511; behind its end stands a smaller one) in the order of their
    first ``depth`` symbols at least, by two-stage sorting."""
    n = len(s)
    ext = np.zeros(n + depth + 8, np.uint16)
    ext[:n] = s
    after = ext[1 : n + 1]
    differs = np.flatnonzero(s != after)
    run_end = differs[np.searchsorted(differs, np.arange(n))] if n else differs  # the last symbol differs from the end's
    small = s[run_end] < ext[run_end + 1]  # smaller than its successor
    direct = np.flatnonzero(small)
    # direct sort, seven symbols of nine bits at a time, of groups that are still tied
    wide = ext.astype(T.U64)
    words = wide[: n + depth]
    for k in range(1, 7):
        words = (words << T.U64(9)) | wide[k : n + depth + k]
    order = direct[np.argsort(words[direct], kind="stable")]
    group = np.concatenate([[0], np.cumsum(words[order][1:] != words[order][:-1])]) if len(order) else order
    for at in range(7, depth, 7):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = words[order[where] + at]
        by = np.lexsort((key, group[where]))
        order[where], key = order[where[by]], key[by]
        split = np.zeros(len(order), bool)
        split[where[1:]] = (group[where[1:]] != group[where[:-1]]) | (key[1:] != key[:-1])
        step = np.zeros(len(order), bool)
        step[1:] = group[1:] != group[:-1]
        group = np.cumsum(split | step)
    # induction: buckets of first symbols in rising order, in each the induced suffixes first
    symbols = np.unique(s)
    cut = np.searchsorted(s[order], np.append(symbols, 1 << 16))
    waiting: dict[int, list[np.ndarray]] = {int(c): [] for c in symbols}
    # the suffix before the end of s is induced by the end itself
    if n and not small[n - 1]:
        waiting[int(s[n - 1])].append(np.array([n - 1]))
    done = []
    for k, c in enumerate(symbols.tolist()):
        layers, level = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(level):
            layers.append(level)
            before = level[level > 0] - 1
            level = before[s[before] == c]
        bucket = np.concatenate([*layers, order[cut[k] : cut[k + 1]]])
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        larger = before[s[before] > c]
        own = s[larger]
        by = np.argsort(own, kind="stable")
        larger, own = larger[by], own[by]
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(own) else []
        begin = 0
        for e in ends:
            waiting[int(own[begin])].append(larger[begin:e])
            begin = e
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def repeated(rows: list[np.ndarray], n: np.ndarray, docs: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """For all windows of all rows, one after the other: whether an equal window stands earlier.

    docs ranks the rows' documents, pos has their starts."""
    sizes = np.array([len(r) for r in rows])
    s = np.ones(int(sizes.sum()) + len(rows), np.uint16)  # 1 ends each row
    begin = np.cumsum(sizes + 1) - sizes - 1
    s[T.spans_index(begin, sizes)] = np.concatenate(rows).astype(np.uint16) + 2
    starts, row = T.spans_index(begin, n), np.repeat(np.arange(len(rows)), n)
    window = np.full(len(s), -1)
    window[starts] = np.arange(len(starts))
    sa = suffix_array(s, length)
    sa = sa[window[sa] >= 0]
    # adjacent common prefixes, as far as length
    ext = np.append(s, np.zeros(8, np.uint16)).astype(np.uint8)  # no window holds a row's end, so bytes + 2 wrap without clash
    blocks = T._blocks(ext)
    common, alive = np.zeros(len(sa), np.int64), np.arange(1, len(sa))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[blocks[sa[alive] + at] == blocks[sa[alive - 1] + at]]
        common[alive] = at + 8
    new = common < length
    order = (docs[row].astype(np.int64) << 40) | (pos[row] + starts - begin[row])
    mine = order[window[sa]]
    first = np.minimum.reduceat(mine, np.flatnonzero(new)) if len(sa) else mine
    out = np.zeros(len(starts), bool)
    out[window[sa]] = mine > first[np.cumsum(new) - 1] if len(sa) else False
    return out


def _sorted_out(length: int):
    """Removed spans of stretches that come sorted by their gathering key."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        d, th, pos, n = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("d", "th", "pos", "n"))
        rows = [np.frombuffer(r, np.uint8) for p in parts for r in p.column("bytes").to_pylist()]
        order = np.lexsort((th, d))
        new = np.ones(len(d), bool)
        new[1:] = (d[order][1:] != d[order][:-1]) | (th[order][1:] != th[order][:-1])
        docs = np.empty(len(d), np.int64)
        docs[order] = np.cumsum(new)
        gone = repeated(rows, n, docs, pos, length)
        first = np.cumsum(n) - n
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        edge[first] = gone[first]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        last[first + n - 1] = gone[first + n - 1]
        a, b = np.flatnonzero(edge), np.flatnonzero(last)
        row = np.searchsorted(first, a, side="right") - 1
        at = pos[row] + a - first[row]
        return pa.RecordBatch.from_pydict({"d": pa.array(d[row]), "th": pa.array(th[row]), "s": pa.array(at), "e": pa.array(at + b - a + length)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, last = [], 0, None
        for b in batches:
            keys = b.column("k").to_numpy()
            if not len(keys):
                continue
            upto = np.concatenate([[0], np.cumsum(pa.compute.binary_length(b.column("bytes")).to_numpy())])
            at = 0
            for c in [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]:  # a group is never divided
                if (c > 0 or keys[0] != last) and held + upto[c] - upto[at] > SA_BYTES:
                    yield solve([*parts, b.slice(at, c - at)])
                    parts, held, at = [], 0, c
            parts.append(b.slice(at))
            held += upto[-1] - upto[at]
            last = keys[-1]
        if parts:
            yield solve(parts)

    return T.lean(run)


def _cut(length: int):
    """Parts of crowded stretches: windows whose minimizer offset falls into one band share the bytes
    from the least to the greatest offset, which become the gathering key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = length - GRAM + 1
        step = -(-grams // PARTS)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                piece = b.slice(at, 2000)
                mh, d, th, pos, n, back = (piece.column(c).to_numpy() for c in ("mh", "d", "th", "pos", "n", "back"))
                size = n + length - 1
                buf, begin = np.frombuffer(b"".join(piece.column("bytes").to_pylist()), np.uint8), np.cumsum(size) - size
                out = []
                for j in range(PARTS):  # window w of a stretch has offset back - w
                    lo, hi = np.maximum(0, back - (j + 1) * step + 1), np.minimum(n - 1, back - j * step)
                    ok = np.flatnonzero(lo <= hi)
                    lo, hi, origin = lo[ok], hi[ok], begin[ok] + back[ok]  # origin: the minimizer
                    shared = origin - j * step, np.full(len(ok), length - step + 1)
                    k = T.hash_spans(buf, *shared, seed=100 + j) ^ T.mix(mh[ok].view(T.U64))
                    whole = begin[ok] + lo, hi - lo + length
                    out.append((k, d[ok], th[ok], pos[ok] + lo, hi - lo + 1, *whole, T.hash_spans(buf, *whole, seed=1), T.hash_spans(buf, *whole, seed=2)))
                k, d, th, pos, n, start, size, c1, c2 = (np.concatenate(x) for x in zip(*out, strict=True))
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut), pa.py_buffer(buf[T.spans_index(start, size)])])
                yield pa.RecordBatch.from_pydict({"mh": pa.array(k.view(np.int64)), "d": pa.array(d), "th": pa.array(th), "pos": pa.array(pos), "n": pa.array(n), "c1": pa.array(c1.view(np.int64)), "c2": pa.array(c2.view(np.int64)), "bytes": data})

    return T.lean(run)


def _windows(length: int):
    """The single windows of parts, with their hashes as gathering key and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                piece = b.slice(at, 2000)
                d, th, pos, n = (piece.column(c).to_numpy() for c in ("d", "th", "pos", "n"))
                buf = np.frombuffer(b"".join(piece.column("bytes").to_pylist()), np.uint8)
                size = n + length - 1
                begin = np.cumsum(size) - size
                start, row, one = T.spans_index(begin, n), np.repeat(np.arange(len(n)), n), np.full(int(n.sum()), length)
                c1, c2 = (T.hash_spans(buf, start, one, seed=k).view(np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_pydict({"mh": pa.array(c1), "d": pa.array(d[row]), "th": pa.array(th[row]), "pos": pa.array(pos[row] + start - begin[row]), "n": pa.array(np.ones(len(row), np.int64)), "c1": pa.array(c1), "c2": pa.array(c2)})

    return T.lean(run)


def _finish_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in T.slices(whole, "text"):
            buf, off = T.text_buffer(b.column("text"))
            out = {"n_bytes": np.diff(off), "n_removed": [], "span_starts": [], "span_ends": [], "kept_sha256": []}
            for k, spans in enumerate(b.column("spans").to_pylist()):
                starts, ends = [], []
                for x in sorted((s["s"], s["e"]) for s in spans or []):
                    if ends and x[0] <= ends[-1]:
                        ends[-1] = max(ends[-1], x[1])
                    else:
                        starts.append(x[0])
                        ends.append(x[1])
                text = buf[off[k] : off[k + 1]]
                kept = hashlib.sha256()
                for a, e in zip([0, *ends], [*starts, len(text)], strict=True):
                    kept.update(text[a:e])
                out["kept_sha256"].append(kept.hexdigest())
                out["n_removed"].append(sum(ends) - sum(starts))
                out["span_starts"].append(starts)
                out["span_ends"].append(ends)
            kinds = {"span_starts": pa.list_(pa.int64()), "span_ends": pa.list_(pa.int64()), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept_sha256 and the maximal removed runs (span_starts / span_ends,
    byte offsets) of every row."""
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = keyed.select("d", "th", "text").filter(F.octet_length("text") >= length)
    counted = rows.select("text").mapInArrow(_count(length), "mh long, n long").groupBy("mh").agg(F.sum("n").alias("n"))
    repeats = written(counted.filter("n > 1").select(F.col("mh").alias("k")), "minimizers")
    minimizers = bloom(repeats)
    narrow = "mh long, d long, th long, pos long, n long, c1 long, c2 long"
    found = written(rows.mapInArrow(_emit(length, spark.sparkContext.broadcast((minimizers, None)), False), narrow), "stretches")

    def judged(t: DataFrame) -> DataFrame:
        """t with the first place of each content and whether a row is that place."""
        # written, so that the join's exchanges stand alone and a hot content can be split between tasks
        firsts = written(t.groupBy("mh", "c1", "c2").agg(F.min(F.struct("d", "th", "pos")).alias("first")), "first_places")
        return t.join(firsts, ["mh", "c1", "c2"]).withColumn("is_first", F.struct("d", "th", "pos") == F.col("first"))

    def covered(t: DataFrame) -> DataFrame:
        return t.filter(~F.col("is_first")).select("d", "th", F.col("pos").alias("s"), (F.col("pos") + F.col("n") + (length - 1)).alias("e"))

    first_level = written(judged(found).select("mh", "d", "th", "pos", "n", "is_first"), "firsts")
    contents = written(first_level.filter("is_first").groupBy("mh").agg(F.count("*").alias("contents")).filter("contents > 1"), "contents")
    gathered = first_level.filter("is_first").join(contents, "mh")
    places = bloom(written(gathered.select(F.xxhash64("d", "th", "pos").alias("k")), "places"))
    both = spark.sparkContext.broadcast((minimizers, places))
    wide = rows.mapInArrow(_emit(length, both, True), "mh long, d long, th long, pos long, n long, back long, bytes binary")
    wide = written(wide.join(contents, "mh"), "gathered")
    spans = "d long, th long, s long, e long"

    def by_suffixes(t: DataFrame) -> DataFrame:
        key = t.select(F.col("mh").alias("k"), "d", "th", "pos", "n", "bytes")
        return key.repartition("k").sortWithinPartitions("k").mapInArrow(_sorted_out(length), spans)

    parts = wide.filter(F.col("contents") > CROWD).drop("contents").mapInArrow(_cut(length), narrow + ", bytes binary")
    crowd = written(judged(written(parts, "parts")).drop("first"), "crowd")
    again = written(crowd.filter("is_first").groupBy("mh").agg(F.count("*").alias("contents")), "contents")
    kept = written(crowd.filter("is_first").join(again, "mh"), "parts_left")
    single = judged(written(kept.filter(F.col("contents") > CROWD).mapInArrow(_windows(length), narrow), "windows"))
    gone = covered(first_level).union(covered(crowd)).union(covered(single))
    gone = gone.union(by_suffixes(wide.filter(F.col("contents") <= CROWD))).union(by_suffixes(kept.filter(F.col("contents") <= CROWD)))
    per_doc = gone.groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # at most as many as the document has windows
    kind = docs.schema[doc_id].dataType.simpleString()
    done = keyed.join(per_doc, ["d", "th"], "left").select("doc_id", "text", "spans")
    return done.mapInArrow(T.lean(_finish_docs), f"doc_id {kind}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept_sha256 string")
