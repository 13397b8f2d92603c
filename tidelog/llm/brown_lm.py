"""Language-model scores by a class-based bigram model with exchange clustering.

P(word | previous) = P(class | previous class) * P(word | class).

Tokens are the words [^\\x20\\x09-\\x0D]+ of a text after lower-casing A-Z, then one end.  Counts
cover all words of all learning documents: a word's count and class are a row of the vocabulary table,
which grows with the corpus and is never gathered.  Classes are made in two steps.  First elements of
a fixed number are exchanged: the most frequent words (at most WORDS), the end, and GROUPS groups of
all other words by a hash of their last three bytes.  The exchange algorithm moves one element at a
time to the class that raises the likelihood of the training bigrams most, until a sweep moves nothing
(at most ``sweeps`` sweeps); the end keeps a class of its own.  Then every further word, each for
itself and all at once, is taken out of its group's class and put into the class that raises that
likelihood most by its own bigrams with the classes of its neighbours.  Class transitions are counted
anew with the classes of all words.  Only unseen words have the class of their group.

Smoothing: P(word | class) = (c + 0.5) / (class tokens + 0.5 * (class words + 1)), where one slot is
left for unseen words; P(class | previous) = (n(previous, class) + BETA * P(class)) / (n(previous) +
BETA).  Counts and classes of the most frequent words (about HEAD, broadcast) are known on the spot;
the other words of a text are joined with the vocabulary table.  Words are told apart by 54 hash bits
and their suffix group.

Null and empty texts are the end alone; texts of any length are scored whole, some bytes at a time.
Rows with equal ids are scored one by one; null ids do not
teach.  Without learning rows every count is 0.  Extra columns are ignored.  An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm._scratch import frequent, written

WORDS, GROUPS, CLASSES, HEAD, BETA = 2047, 512, 64, 1 << 18, 2.0
#: Class of a word that is looked up in the vocabulary table.
BEYOND = 255
#: A token's key: its suffix group above the low BITS bits of its hash.  Ends have a group of their own.
BITS = 54
END = T.U64(1023 << BITS)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words and ends, first token of each text)."""
    h, first, buf, starts, lens = T.words_of(col)
    k = np.minimum(lens, 3)
    group = T.hash_spans(buf, starts + lens - k, k, seed=3) % T.U64(GROUPS)
    key = np.maximum((h & T.U64((1 << BITS) - 1)) | (group << T.U64(BITS)), T.U64(1))
    return np.insert(key, first[1:], END), first + np.arange(len(first))


@dataclass
class Elements:
    """Index of clustered elements: frequent words first, then the end, then the suffix groups."""

    index: T.HashIndex
    n_words: int

    def of(self, key: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = self.index.find(key) if at is None else at
        group = (key >> T.U64(BITS)).astype(np.int64)
        return np.where(key == END, self.n_words, np.where((at >= 0) & (at < self.n_words), at, self.n_words + 1 + group))

    @property
    def size(self) -> int:
        return self.n_words + 1 + GROUPS


def _count(key_rows, columns: list[str]):
    """Mapper that counts the 64-bit keys of key_rows(text column), a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = T.Counter()

        def give(found):
            if found is not None:
                for at in range(0, len(found[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(found[0][at : at + (1 << 17)].view(np.int64)), pa.array(found[1][at : at + (1 << 17)])], columns)

        for whole in batches:
            for b in T.slices(whole, "text"):
                yield from give(counter.add(key_rows(b.column("text"))))
        yield from give(counter.rest())

    return T.lean(run)


def exchange(counts: np.ndarray, n_classes: int, fixed: int, sweeps: int = 12) -> np.ndarray:
    """Classes of the elements of a bigram count matrix; element ``fixed`` stays alone in class 0.

    The gain of a move is the change of sum(n log n) over class bigrams less that over the classes'
    left and right totals."""
    size = len(counts)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    order = order[(order != fixed) & (weight[order] > 0)]
    cls = np.zeros(size, np.int64)
    others = np.flatnonzero(np.arange(size) != fixed)
    by_weight = others[np.argsort(-weight[others], kind="stable")]
    cls[by_weight] = 1 + np.arange(len(by_weight)) % (n_classes - 1)
    one = np.eye(n_classes)[cls]
    out, into = counts @ one, counts.T @ one  # element to class, class to element
    big = one.T @ out
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = cls[w], counts[w, w]
            big[a] -= out[w]
            big[:, a] -= into[w]
            big[a, a] += own
            o, i = out[w].copy(), into[w].copy()
            o[a] -= own
            i[a] -= own
            rows, cols = f(big + o) - f(big), f(big.T + i) - f(big.T)
            gain = rows.sum(axis=1) + cols.sum(axis=1)
            d = np.diagonal(big)
            gain += f(d + o + i + own) - f(d) - np.diagonal(rows) - np.diagonal(cols)
            left, right = big.sum(axis=1), big.sum(axis=0)
            gain -= f(left + o.sum() + own) - f(left) + f(right + i.sum() + own) - f(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            big[b] += o
            big[:, b] += i
            big[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                col_in, col_out = counts[:, w], counts[w]
                out[:, a] -= col_in
                out[:, b] += col_in
                into[:, a] -= col_out
                into[:, b] += col_out
        if not moved:
            break
    return cls


class Moves:
    """Best classes of single words, each against the same class bigrams."""

    FEW = 8  # gains of this many counts at one class are tabled

    def __init__(self, big: np.ndarray):
        self.big, self.n = big, len(big)
        self.left, self.right = big.sum(axis=1), big.sum(axis=0)
        # [k, c, b]: gain of k more bigrams of b before c, or of c before b
        self.tables = [np.stack([self.f(m + k) - self.f(m) for k in range(self.FEW)]) for m in (big.T, big)]

    @staticmethod
    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    def best(self, own: np.ndarray, out: np.ndarray, into: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Classes of words (rows) that ``own`` holds now; out and into count the words' bigrams by the
        class of the other word, but for those with themselves, which are ``alone``."""
        f, rows = self.f, np.arange(len(own))
        gain, diagonal = np.zeros(out.shape), []
        for (m, by_few), mine, other in zip(((self.big.T, self.tables[0]), (self.big, self.tables[1])), (out, into), (into, out), strict=True):
            w, c = np.nonzero(mine)
            k, a = mine[w, c], own[w]
            few = k < self.FEW
            g = np.empty((len(w), self.n))
            g[few] = by_few[k[few].astype(np.int64), c[few]]
            g[~few] = f(m[c[~few]] + k[~few, None]) - f(m[c[~few]])
            # without the word, its class has less
            less = m[c, a] - k
            g[np.arange(len(w)), a] = f(m[c, a]) - f(less)
            at = np.flatnonzero(c == a)
            held = m[c[at]] - other[w[at]]
            held[np.arange(len(at)), a[at]] -= k[at] + alone[w[at]]
            g[at] = f(held + k[at, None]) - f(held)
            d = np.zeros(out.shape)
            d[w, c] = g[np.arange(len(w)), c]
            diagonal.append(d)
            if len(w):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                gain[w[first]] += np.add.reduceat(g, first, axis=0)
        d = np.tile(np.diagonal(self.big), (len(own), 1))
        d[rows, own] -= out[rows, own] + into[rows, own] + alone
        gain += f(d + out + into + alone[:, None]) - f(d) - diagonal[0] - diagonal[1]
        for side, bigrams in ((self.left, out), (self.right, into)):
            total, t = bigrams.sum(axis=1) + alone, np.tile(side, (len(own), 1))
            t[rows, own] -= total
            gain -= f(t + total[:, None]) - f(t)
        gain[:, 0] = -np.inf
        b = np.argmax(gain, axis=1)
        return np.where(gain[rows, b] > gain[rows, own] + 1e-9, b, own)


def _neighbours(start):
    """Mapper that gives each token of a word beyond the exchanged ones as a row (key, around): the class
    before it times CLASSES + 1, plus the class behind it; CLASSES where that is the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                elements, classes = start.value
                key, first = tokens(b.column("text"))
                at = elements.index.find(key)
                cls = classes[elements.of(key, at)]
                before, behind = np.roll(cls, 1), np.roll(cls, -1)
                before[first[:-1]] = classes[elements.n_words]
                same = np.flatnonzero(key[1:] == key[:-1])  # of ends too, which give no rows
                before[same + 1] = behind[same] = CLASSES
                on = np.flatnonzero((at < 0) & (key != END))
                for lo in range(0, len(on), 1 << 17):
                    some = on[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array((before[some] * (CLASSES + 1) + behind[some]).astype(np.int32))], ["key", "around"])

    return T.lean(run)


def _assign(start, moves, at_once: int = 512):
    """Mapper of _neighbours' rows, those of a word together, to rows (key, n, cls), one per word."""

    def classes(key, around):
        keys, w = np.unique(key, return_inverse=True)
        elements, own = start.value
        own = own[elements.n_words + 1 + (keys >> T.U64(BITS)).astype(np.int64)]
        into, out = (np.bincount(w * (CLASSES + 1) + c, minlength=len(keys) * (CLASSES + 1)).reshape(len(keys), -1).astype(float) for c in (around // (CLASSES + 1), around % (CLASSES + 1)))
        cls = moves.value.best(own, out[:, :CLASSES], into[:, :CLASSES], out[:, CLASSES])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(out.sum(axis=1).astype(np.int64)), pa.array(cls)], ["key", "n", "cls"])

    def by_words(key, around, end):
        begins = np.flatnonzero(np.append(True, key[1:end] != key[: end - 1])) if end else np.zeros(0, np.int64)
        begins = np.append(begins[::at_once], end)
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            yield classes(key[lo:hi], around[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, 1 << 15
        for b in batches:
            held.append((b.column("key").to_numpy().view(T.U64), b.column("around").to_numpy()))
            size += b.num_rows
            if size > enough:
                key, around = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.flatnonzero(key == key[-1])[0])  # the last word may go on
                yield from by_words(key, around, last)
                held, size = [(key[last:], around[last:])], len(key) - last
                enough = max(1 << 15, 2 * size)
        if size:
            yield from by_words(*(np.concatenate(x) for x in zip(*held, strict=True)), size)

    return T.lean(run)


@dataclass
class Model:
    elements: Elements
    head_counts: np.ndarray
    head_classes: np.ndarray
    classes: np.ndarray
    log_trans: np.ndarray
    log_den: np.ndarray
    n: int
    v: int
    end_count: int

    @property
    def end_class(self) -> int:
        return int(self.classes[self.elements.n_words])

    def group_classes(self, key: np.ndarray) -> np.ndarray:
        return self.classes[self.elements.n_words + 1 + (key >> T.U64(BITS)).astype(np.int64)]

    def local(self, col: pa.Array) -> dict:
        """What is known of a text column without the vocabulary table: classes by token (a byte each,
        BEYOND for words beyond the head), those words (tail) and which of them each such token is."""
        key, first = tokens(col)
        at = self.elements.index.find(key)
        end, known = key == END, at >= 0
        c, cls = np.zeros(len(key), np.int64), np.full(len(key), BEYOND, np.uint8)
        c[known], cls[known] = self.head_counts[at[known]], self.head_classes[at[known]]
        c[end], cls[end] = self.end_count, self.classes[self.elements.n_words]
        counts = T.per_text(np.log10(c + 0.5), first)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        tail = np.flatnonzero(cls == BEYOND)
        one, which = T.distinct(text[tail].astype(T.U64), key[tail])
        of_text = np.searchsorted(text[tail][one], np.arange(len(first)))
        lists = lambda values, starts: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))
        return {
            "n_tokens": pa.array(np.diff(first)), "n_known": pa.array(T.per_text(c > 0, first)), "counts": pa.array(counts),
            "classes": pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(cls)]),
            "tail": lists(key[tail][one].view(np.int64), of_text),
            "which": lists((which - of_text[text[tail]]).astype(np.int32), np.searchsorted(tail, first)),
        }


def _local(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in T.slices(whole, "text"):
                yield pa.RecordBatch.from_pydict({"rid": pa.array(rid + np.arange(b.num_rows)), "doc_id": b.column("doc_id")} | model.value.local(b.column("text")))
                rid += b.num_rows

    return T.lean(run)


def _resolved(rows: DataFrame, model, vocab: DataFrame) -> DataFrame:
    """Model.local of rows(doc_id, text), with found: (j, n, cls) of each word of tail that vocab knows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, n_tokens long, n_known long, counts double, classes binary, tail array<long>, which array<int>"
    local = written(rows.mapInArrow(_local(model), schema), "classes")
    beyond = local.select("rid", F.posexplode("tail").alias("j", "key")).join(vocab, "key")
    more = beyond.groupBy("rid").agg(F.collect_list(F.struct("j", "n", "cls")).alias("found"))
    return local.join(more, "rid", "left").drop("rid")


def _filled(model, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of _resolved's rows: classes of all tokens, the first token of each text, the number of known
    tokens and the sum of log10(count + 0.5) of each text."""
    cls, first = T.text_buffer(b.column("classes"))
    cls = cls.astype(np.int64)
    lens = {c: pc.list_value_length(b.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tail", "which", "found")}
    of_text = np.cumsum(lens["tail"]) - lens["tail"]
    word_cls, word_n = model.group_classes(b.column("tail").flatten().to_numpy().view(T.U64)), np.zeros(lens["tail"].sum(), np.int64)
    found = b.column("found").flatten()
    at = np.repeat(of_text, lens["found"]) + found.field("j").to_numpy()
    word_cls[at], word_n[at] = found.field("cls").to_numpy(), found.field("n").to_numpy()
    word = np.repeat(of_text, lens["which"]) + b.column("which").flatten().to_numpy()
    cls[cls == BEYOND] = word_cls[word]
    each = np.append(0, np.cumsum(lens["which"]))
    known = b.column("n_known").to_numpy() + T.per_text(word_n[word] > 0, each)
    return cls, first, known, b.column("counts").to_numpy() + T.per_text(np.log10(word_n[word] + 0.5) - np.log10(0.5), each)


def _before(cls: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    before = np.roll(cls, 1)
    before[first[:-1]] = end
    return before


def _transitions(model):
    """Mapper of _resolved's rows to numbers of class bigrams, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES * CLASSES, np.int64)
        for whole in batches:
            for b in T.slices(whole, "classes", 1 << 20):
                cls, first, _, _ = _filled(model.value, b)
                n += np.bincount(_before(cls, first, model.value.end_class) * CLASSES + cls, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    return T.lean(run)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in T.slices(whole, "classes", 1 << 20):
                cls, first, known, counts = _filled(m, b)
                n = np.diff(first)
                score = counts + T.per_text(m.log_trans[_before(cls, first, m.end_class), cls] - m.log_den[cls], first)
                base = counts - n * np.log10(m.n + 0.5 * (m.v + 1))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), m.n)), "base_score": pa.array(base), "score": pa.array(score)})

    return T.lean(run)


def learn(docs: DataFrame, learn_from, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (key long, n long, cls long) of all learning words but the exchanged."""
    spark = docs.sparkSession
    rows = docs.filter(learn_from).select(F.col(text).alias("text"))
    vocab = written(rows.mapInArrow(_count(lambda col: tokens(col)[0], ["key", "n"]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "vocabulary")
    on_top = frequent(vocab, HEAD, "key")
    end = F.col("key") == int(END.view(np.int64))
    end_count = vocab.filter(end).agg(F.sum("n")).first()[0] or 0
    head = vocab.filter(~end & on_top).toArrow()
    keys, counts = head["key"].to_numpy().view(T.U64), head["n"].to_numpy().astype(np.int64)
    order = np.lexsort((keys, -counts))
    keys, counts = keys[order], counts[order]
    elements = Elements(T.HashIndex(keys), min(WORDS, len(keys)))
    exchanged = spark.sparkContext.broadcast(Elements(T.HashIndex(keys[:WORDS]), elements.n_words))

    def pairs(col: pa.Array) -> np.ndarray:
        key, first = tokens(col)
        e = exchanged.value.of(key).astype(T.U64)
        before = np.roll(e, 1)
        before[first[:-1]] = exchanged.value.n_words
        return (before << T.U64(32)) | e

    found = rows.mapInArrow(_count(pairs, ["pair", "n"]), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair = found["pair"].to_numpy()
    grams = np.zeros((elements.size, elements.size))
    grams[pair >> 32, pair & 0xFFFFFFFF] = found["n"].to_numpy()
    cls = exchange(grams, CLASSES, elements.n_words)
    one = np.eye(CLASSES)[cls]
    start, moves = spark.sparkContext.broadcast((exchanged.value, cls)), spark.sparkContext.broadcast(Moves(one.T @ grams @ one))
    around = rows.mapInArrow(_neighbours(start), "key long, around int").repartition("key").sortWithinPartitions("key")
    further = written(around.mapInArrow(_assign(start, moves), "key long, n long, cls long"), "classes")
    in_head = further.filter(on_top).toArrow()
    head_classes = np.zeros(len(keys), np.uint8)
    head_classes[elements.index.find(in_head["key"].to_numpy().view(T.U64))] = in_head["cls"].to_numpy()
    head_classes[: elements.n_words] = cls[: elements.n_words]
    totals = vocab.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    model = Model(elements, counts, head_classes, cls, None, None, totals.n or 0, totals.k, end_count)
    sent = spark.sparkContext.broadcast(model)
    found = _resolved(rows.withColumn("doc_id", F.lit(0)), sent, further).mapInArrow(_transitions(sent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    big = np.zeros(CLASSES * CLASSES)
    big[found["pair"].to_numpy()] = found["n"].to_numpy()
    big = big.reshape(CLASSES, CLASSES)
    total = big.sum(axis=0)
    share = (total + 1) / (total.sum() + CLASSES)
    trans = (big + BETA * share) / (big.sum(axis=1, keepdims=True) + BETA)
    distinct = np.bincount(cls[: elements.n_words], minlength=CLASSES).astype(float)
    distinct[model.end_class] += end_count > 0
    for r in further.groupBy("cls").agg(F.count("*").alias("k")).collect():
        distinct[r.cls] += r.k
    return replace(model, log_trans=np.log10(trans), log_den=np.log10(total + 0.5 * (distinct + 1))), further


def score(docs: DataFrame, model: Model, vocab: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row, whole texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _resolved(rows, sent, vocab).mapInArrow(_scores(sent), schema)
