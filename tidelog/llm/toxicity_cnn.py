"""Toxicity scores by a convolutional text classifier, trained in numpy on all labelled documents.

A word is a run of letters, digits and non-ASCII characters after lower-casing A-Z.  Its vector is
the sum of three rows of one hashed embedding table: the word's and those of its first five and four
bytes.  Filters of several widths run over the words (zeros follow each text), the largest response
of each filter in the whole text passes a rectifier, and a logistic unit reads all of them.

Training: every labelled document takes part; a fifth of them, by a hash of the id, only calibrates.
Embeddings start from small noise plus, on the first channel, a lower confidence bound of the feature's log
odds between the classes, counted over all learning texts; then everything is trained by Adam on the log loss.
The driver makes the start on a bounded sample, about ``per_class`` of each class and ``most_words`` words (12
bytes each) in all, without documents of more than a hundredth of ``most_words``.  Where the sample isn't all
there is, ``passes`` passes over all learning texts follow: these, dealt by a hash of the id into replicas of
about REPLICA documents, are trained on by the workers, each replica from the shared network on; then the
replicas are averaged (a table row over those that changed it) into the next shared network.
Thresholds are calibrated by language: on all calibration rows of each language (as predicted from
the text by language_bloom, learned from all learning rows; labels of fewer than ``least`` toxic rows fall back to all languages) the
logit of the best F1 is found, on a grid of 1/GRID so that the driver gets counts and not rows, and scores are
shifted so that 0.5 is the threshold everywhere.

Null and empty texts are texts without words and get a score like any other; texts of any length are
scored whole.  Repeated rows are scored one by one.  An empty table gives no rows.  A document with several
labels is toxic if any of them is 1; null labels and null ids do not teach.  Without rows of both
classes the score is the smoothed share of toxic rows.  Extra columns are ignored by ``score`` and
kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm import language_bloom
from tidelog.llm._scratch import written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
REPLICA, SLOTS, GRID, CLIP = 4000, 1024, 256, 32
PAD = max(WIDTHS)  # so that a text without words has a place for the widest filter


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows (words, 3) of all texts, and each text's first word."""
    buf, off = T.text_buffer(col)
    buf = T.LOWER[buf]
    starts, lens, first = T.word_spans(buf, off, T.ALNUM_WORD)
    rows = np.stack([T.hash_spans(buf, starts, np.minimum(lens, k), seed=k) for k in (1 << 20, 5, 4)], axis=1)
    return (rows % T.U64(BUCKETS - 1)).astype(np.int32) + 1, first


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with PAD empty words (row 0) at the end of each text."""
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(n + PAD)])
    out = np.zeros((int(begin[-1]), 3), np.int32)
    out[T.spans_index(begin[:-1], n)] = rows
    return out, begin


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return padded(*words_of(col))


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    prior: float = 0.0
    languages: object = None
    shift: dict = field(default_factory=dict)  # of each language's logits; "" for all others

    def responses(self, x: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the responses of its filters at every word; none (minus infinity) where a filter
        would reach into the next text."""
        for w, b in zip(self.filters, self.bias, strict=True):
            r = x @ w[0]
            for k in range(1, len(w)):
                r[:-k] += (x @ w[k])[k:]
            for k in range(1, len(w)):
                r[first[1:] - k] = -np.inf
            yield r + b

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.table[rows].sum(axis=1)
        return np.maximum(0, np.concatenate([np.maximum.reduceat(r, first[:-1], axis=0) for r in self.responses(x, first)], axis=1))

    def logits(self, col: pa.Array) -> np.ndarray:
        if self.out is None or not len(col):
            return np.full(len(col), self.prior)
        return self.of_features(*features(col))

    def of_features(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first) @ self.out + self.out_bias

    def scores(self, col: pa.Array) -> np.ndarray:
        z = self.logits(col).astype(float)
        if self.shift:
            langs = self.languages.predict(col.to_pylist())[0]
            z = z - np.array([self.shift.get(k, self.shift[""]) for k in langs])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def step(self, key, value: np.ndarray, grad: np.ndarray) -> None:
        m, v, t = self.state.get(key, (0, 0, 0))
        m, v, t = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, t + 1
        self.state[key] = m, v, t
        value -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def fit(col: pa.Array, y: np.ndarray, **fitting) -> Network:
    """The network trained on texts and their labels (0 or 1)."""
    return fit_features(*words_of(col), y, **fitting)


def feature_counts(rows: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(BUCKETS, 2): texts of label 1 and of label 0 with each feature, every text with the empty word."""
    found = np.zeros((BUCKETS, 2))
    n = np.diff(first)
    for at in range(0, len(y), 256):  # distinct features of each text
        own = slice(first[at], first[min(at + 256, len(y))])
        text = np.repeat(np.arange(len(n[at : at + 256])), n[at : at + 256])
        seen = np.unique(text[:, None].astype(np.int64) * BUCKETS + rows[own])
        label = y[at + seen // BUCKETS]
        found[:, 0] += np.bincount(seen % BUCKETS, label, BUCKETS)
        found[:, 1] += np.bincount(seen % BUCKETS, 1 - label, BUCKETS)
    return found


class Training:
    """Steps of a network on texts; weight of each class in the loss."""

    def __init__(self, net: Network, share: float, rate: float = 1.0):
        self.net, self.weight, self.rate = net, (0.5 / (1 - share), 0.5 / share), rate
        self.adam, self.sparse, self.out_bias = Adam(0.01 * rate), np.zeros(BUCKETS, np.float32), np.array([net.out_bias], np.float32)

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """One step on texts (words and PAD empty words each)."""
        net, adam = self.net, self.adam
        weight = np.where(y > 0, self.weight[1], self.weight[0])
        size = np.array([len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum(size)])
        r3 = np.concatenate(texts)
        x = net.table[r3].sum(axis=1)
        pools, where = [], []
        for r in net.responses(x, begin):
            best = np.maximum.reduceat(r, begin[:-1], axis=0)
            hit = r == np.repeat(best, size, axis=0)
            place = np.where(hit, np.arange(len(r))[:, None], len(r))
            where.append(np.minimum.reduceat(place, begin[:-1], axis=0))
            pools.append(best)
        pool = np.concatenate(pools, axis=1)
        act = np.maximum(0, pool)
        z = act @ net.out + self.out_bias[0]
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight / len(y)
        back = (err[:, None] * net.out) * (pool > 0)
        grad_x: dict[str, list] = {"at": [], "g": []}
        for k, w in enumerate(net.filters):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            gw = np.zeros_like(w)
            for j in range(len(w)):
                pos_at = np.minimum(where[k] + j, len(x) - 1)
                gw[j] = np.einsum("bfd,bf->df", x[pos_at], g)
                grad_x["at"].append(pos_at.ravel())
                grad_x["g"].append((g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
            adam.step(("w", k), w, gw + 1e-4 * w)
            adam.step(("b", k), net.bias[k], g.sum(axis=0))
        adam.step("out", net.out, act.T @ err + 1e-4 * net.out)
        adam.step("bias", self.out_bias, np.array([err.sum()], np.float32))
        at_word, g = np.concatenate(grad_x["at"]), np.concatenate(grad_x["g"])
        target, g = r3[at_word].ravel(), np.repeat(g, 3, axis=0)
        some = (np.abs(g).sum(axis=1) > 0) & (target > 0)
        u, inv = np.unique(target[some], return_inverse=True)
        total = np.zeros((len(u), DIM), np.float32)
        np.add.at(total, inv, g[some])
        self.sparse[u] += (total**2).mean(axis=1)
        net.table[u] -= 0.05 * self.rate * total / (np.sqrt(self.sparse[u])[:, None] + 1e-6)
        net.out_bias = float(self.out_bias[0])


def fit_features(rows: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 6, batch: int = 64, counts: np.ndarray | None = None, size: tuple[int, int] | None = None) -> Network:
    """The network trained on the words of texts (see words_of) and their labels.  counts (see feature_counts)
    and size, numbers of texts of label 1 and 0: those of more texts than these."""
    rng = np.random.default_rng(seed)
    ones, zeros = size or (y.sum(), (1 - y).sum())
    prior = float(np.log((ones + 0.5) / (zeros + 0.5)))
    if not (ones > 0 and zeros > 0):
        return Network(None, [], [], None, 0.0, prior)
    both, none = 0 < y.sum() < len(y), np.zeros((PAD, 3), np.int32)
    pos, neg = (feature_counts(rows, first, y) if counts is None else counts).T
    of_text = lambda d: np.concatenate([rows[first[d] : first[d + 1]], none])
    odds = np.log((pos + 0.5) / (ones + 1)) - np.log((neg + 0.5) / (zeros + 1))
    bound = np.where(odds > 0, np.maximum(0, odds - 1.5 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))), 0) * (pos + neg > 0)
    table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32) * (pos + neg > 0)[:, None].astype(np.float32)
    table[:, 0] += bound / 3
    table[0] = 0
    net = Network(
        table, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))), prior,
    )
    for w in net.filters:
        w[0, 0, 0] = 1.0
    net.out[::FILTERS] = 1.0
    training = Training(net, float(y.mean()) if both else 0.5)
    for _ in range(epochs if both else 0):  # a start without both classes takes no steps
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            training.step([of_text(d) for d in own.tolist()], y[own])
    return net


def _vectors(table: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """Rows (slot, data) of a table of BUCKETS rows and of what else is summed."""
    table = np.ascontiguousarray(table.reshape(SLOTS, -1), np.float32)
    return pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(SLOTS + 1, dtype=np.int32)), "data": pa.array([v.tobytes() for v in (*table, rest.astype(np.float32))], pa.binary())})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, data in zip(b.column("slot").to_pylist(), b.column("data").to_pylist(), strict=True):
            v = np.frombuffer(data, np.float32).astype(np.float64)
            total[slot] = total[slot] + v if slot in total else v
    yield pa.RecordBatch.from_pydict({"slot": pa.array(list(total), pa.int32()), "data": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums of _vectors, as (BUCKETS, columns) and what else."""
    rows = parts.repartition("slot").mapInArrow(T.lean(_sum), "slot int, data binary").toArrow()
    of = {k: np.frombuffer(v, np.float64) for k, v in zip(rows["slot"].to_pylist(), rows["data"].to_pylist(), strict=True)}
    return np.concatenate([of[k] for k in range(SLOTS)]).reshape(BUCKETS, -1), of[SLOTS]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros((BUCKETS, 2))
    for whole in batches:
        for b in T.slices(whole, "text", 1 << 20):
            found += feature_counts(*words_of(b.column("text")), b.column("y").to_numpy().astype(float))
    yield _vectors(found, np.ones(1))


def _dense(net: Network) -> np.ndarray:
    return np.concatenate([*(w.ravel() for w in net.filters), *net.bias, net.out, [net.out_bias]])


def _taught(net, share: float, rate: float, batch: int = 64, most_words: int = 200_000):
    """Mapper of rows (r, y, text), replica by replica, to the replicas' changes of the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, training, texts, y, words = None, None, [], [], 0

        def taken():
            nonlocal texts, y, words
            if texts:
                training.step(texts, np.array(y, float))
            texts, y, words = [], [], 0

        def changes():
            taken()
            change = training.net.table - net.value.table
            touched = (change != 0).any(axis=1, keepdims=True)
            return _vectors(np.concatenate([change, touched], axis=1), np.append(_dense(training.net) - _dense(net.value), 1))

        for whole in batches:
            for b in T.slices(whole, "text", 1 << 20):
                rows, first = padded(*words_of(b.column("text")))
                for k, (r, label) in enumerate(zip(b.column("r").to_pylist(), b.column("y").to_pylist(), strict=True)):
                    if r != own:
                        if training is not None:
                            yield changes()
                        start = net.value
                        own, training = r, Training(replace(start, table=start.table.copy(), filters=[w.copy() for w in start.filters], bias=[v.copy() for v in start.bias], out=start.out.copy()), share, rate)
                    texts.append(rows[first[k] : first[k + 1]])
                    y.append(label)
                    words += len(texts[-1])
                    if len(texts) == batch or words > most_words:
                        taken()
        if training is not None:
            yield changes()

    return T.lean(run)


def _averaged(net: Network, parts: DataFrame) -> Network:
    """The network moved by the mean change of all replicas."""
    table, rest = _summed(parts)
    moved = (_dense(net) + rest[:-1] / rest[-1]).astype(np.float32)
    cut = np.cumsum([w.size for w in net.filters] + [len(b) for b in net.bias] + [len(net.out)])
    pieces = np.split(moved, cut)
    n = len(net.filters)
    return replace(
        net, table=net.table + (table[:, :DIM] / np.maximum(table[:, [DIM]], 1)).astype(np.float32), filters=[v.reshape(w.shape) for v, w in zip(pieces[:n], net.filters, strict=True)],
        bias=pieces[n : 2 * n], out=pieces[2 * n], out_bias=float(pieces[-1][0]),
    )


def best_logit(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of the largest F1, midway to the next lower logit; y is the toxic ones of n rows (1)."""
    order = np.argsort(-z, kind="stable")
    z, y, n = z[order], y[order], np.ones(len(z)) if n is None else n[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no threshold falls between equal logits
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tie, y, text) to rows (id, tie, y, n, words): what the start needs of a text."""
    for whole in batches:
        for b in T.slices(whole, "text", 1 << 20):
            rows, first = words_of(b.column("text"))
            words = pa.ListArray.from_arrays(pa.array((3 * first).astype(np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "tie": b.column("tie"), "y": b.column("y"), "n": pa.array(np.diff(first)), "words": words})


def _graded(net):
    """Mapper of calibration rows (y, text) to rows (lang, z, y), z on the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text", 1 << 20):
                z = np.round(np.clip(net.value.logits(b.column("text")).astype(float), -CLIP, CLIP) * GRID).astype(np.int32)
                langs = pa.array(net.value.languages.predict(b.column("text").to_pylist())[0], pa.string())
                yield pa.RecordBatch.from_pydict({"lang": langs, "z": pa.array(z), "y": b.column("y")})

    return T.lean(run)


def learn(docs: DataFrame, labels: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", per_class: int = 4000, most_words: int = 6_000_000, least: int = 20, passes: int = 2, **fitting) -> Network:
    """A calibrated network from the rows of docs (and of labels) where learn_from(frame) is true."""
    spark, unit = docs.sparkSession, 1 << 30
    known = labels.filter(learn_from(labels)).filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    ids = known.count()
    languages = language_bloom.learn(docs, learn_from(docs), doc_id, text, lang, whole=True)  # before the sample is held
    rows = docs.filter(learn_from(docs)).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(known) if ids <= 1 << 20 else known, "id")
    replica = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-ids * 4 // (5 * REPLICA)) or 1)).cast("int").alias("r")
    rows = rows.select("id", "tie", "text", "y", (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) == 4).alias("test"), replica)
    rows = written(rows.repartition("r").sortWithinPartitions("r", F.xxhash64("id", "tie"), "id", "tie"), "labelled")
    size = {(r.test, r.y): r.n for r in rows.groupBy("test", "y").agg(F.count("*").alias("n")).collect()}
    taught, ones, zeros = rows.filter("NOT test").drop("test"), size.get((False, 1), 0), size.get((False, 0), 0)
    share = F.when(F.col("y") == 1, int(unit * min(1, per_class / max(1, ones)))).otherwise(int(unit * min(1, per_class / max(1, zeros))))
    kind = rows.schema["id"].dataType.simpleString()
    sample = taught.filter(F.pmod(F.xxhash64("id"), F.lit(unit)) < share).select("id", "tie", "y", "text")
    sample = written(sample.mapInArrow(T.lean(_sampled), f"id {kind}, tie long, y int, n long, words array<int>"), "sample").filter(F.col("n") <= most_words // 100)
    total = sample.agg(F.sum("n")).first()[0] or 0
    sample = sample.filter(F.pmod(F.xxhash64("id", "tie"), F.lit(unit)) < int(unit * min(1, most_words / max(total, 1))))
    found = sample.orderBy("id", "tie").select("y", "n", "words").toArrow().combine_chunks()
    y, n = found["y"].to_numpy().astype(float), found["n"].to_numpy()
    words = found["words"].combine_chunks().flatten().to_numpy().reshape(-1, 3)
    del found
    whole = len(y) == ones + zeros
    if not whole:
        fitting |= {"counts": _summed(taught.select("text", "y").mapInArrow(T.lean(_counted), "slot int, data binary"))[0], "size": (ones, zeros)}
    net = fit_features(words, np.concatenate([[0], np.cumsum(n)]), y, **fitting)
    del words
    T.give_back()
    if net.out is None:
        return net
    for k in range(0 if whole else passes):
        sent = spark.sparkContext.broadcast(net)
        net = _averaged(net, taught.select("r", "y", "text").mapInArrow(_taught(sent, ones / (ones + zeros), 0.3 / (k + 1)), "slot int, data binary"))
        sent.unpersist()
    if not (size.get((True, 1)) and size.get((True, 0))):
        return net
    net.languages = languages
    sent = spark.sparkContext.broadcast(net)
    graded = rows.filter("test").select("y", "text").mapInArrow(_graded(sent), "lang string, z int, y int")
    bins = graded.groupBy("lang", "z").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("lang", "z").toArrow()
    langs, z, y, n = np.array(bins["lang"].to_pylist(), dtype=object), bins["z"].to_numpy() / GRID, bins["y"].to_numpy().astype(float), bins["n"].to_numpy().astype(float)
    net.shift = {"": best_logit(*_merged(z, y, n))}
    for k in set(langs.tolist()):
        own = langs == k
        if y[own].sum() >= least and (n - y)[own].sum() >= least:
            net.shift[k] = best_logit(z[own], y[own], n[own])
    return net


def _merged(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one entry for each z."""
    one, at = np.unique(z, return_inverse=True)
    return one, np.bincount(at, y), np.bincount(at, n)


def _run(net, text: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, text, 1 << 20):
                s = net.value.scores(b.column(text))
                if keep:
                    yield b.filter(pa.array(s < 0.5))
                else:
                    yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != text} | {"score": pa.array(s)})

    return T.lean(run)


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1; toxic from 0.5 on) for every row, from the whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(net), "text", False), f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with a score under 0.5."""
    return docs.mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(net), text, True), docs.schema)
