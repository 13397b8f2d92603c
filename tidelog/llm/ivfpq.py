"""Approximate nearest neighbours by largest inner product: inverted lists with product-quantised residuals.

``fit`` learns coarse centroids, about as many as the root of the number of rows, and, for each of
``parts`` slices of the residuals, a codebook of up to 256 entries.  It learns from a bounded sample of
vectors, by a hash of the id: PER_LIST rows for each list, from 16384 up to ``sample`` rows, which also
bounds the lists.  A first number of lists to probe holds ``aim`` of the true neighbours of sample rows in the
sample.  ``encode`` puts every row into its list.  ``tuned`` then measures up to TRIED of the real queries by
brute force over every row: queries need not look like rows, and rare rows may be missing in the sample.  It
probes the fewest lists that hold ``aim`` of all those neighbours, and for 95 % of the queries nine tenths of
their own, and it finds the ``slack``, how far scores by codes fall short of a true neighbour's, in units of the
query's length times the row's own coding error (1 at most, by Cauchy and Schwarz, which holds without tuning).
``search`` scores rows by asymmetric distance tables (query times centroid plus one table entry a slice),
takes each shard's best by that score with all rows tied to them, then all rows that the slack lets reach the
k-th of these, however many that are, and ranks those exactly, in double precision on the original vectors, ties
to the smaller id.

Lists are dealt into shards of about SHARD rows: long lists are split by a hash of the id, short ones
share a shard, so one crowded centroid makes many tasks.  A task holds one shard and streams the
queries that probe it; a query is sent once to each shard with a list that it probes.  The best of a
query are merged in levels of GROUP shards, so no task gathers more than GROUP * k of them.

Vectors that are null, zero, hold null or non-finite components, or have another length than most of
the sample take no part, neither as queries nor as candidates; nor do rows without an id.  A query
never finds rows with its own id; rows that share another id are candidates one by one.  Fewer than k candidates give shorter answers; empty tables give no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm._scratch import written

SHARD, GROUP, PER_LIST, TRIED = 1024, 64, 16, 256


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and embedding of all rows that take part, but for their length."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def matrix(col: pa.Array) -> np.ndarray:
    """A column of lists of one length, as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row."""
    return np.argmax(x @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Index:
    dim: int
    centers: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # for each slice: (entries, width)
    probes: int
    slack: float = 1.0

    def slices(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([b.shape[1] for b in self.books])])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each row."""
        own = nearest(x, self.centers)
        rest, cut = x - self.centers[own], self.slices()
        return own, np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(cut[:-1], cut[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes tell of each row."""
        return self.centers[own] + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Whether each query probes each list."""
        s = q @ self.centers.T
        return s >= np.partition(s, len(self.centers) - self.probes, axis=1)[:, [len(self.centers) - self.probes]]

    def approximate(self, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric scores (queries, rows); minus infinity in lists that a query doesn't probe."""
        s = np.where(self.probed(q), q @ self.centers.T, -np.inf).T[own]
        cut = self.slices()
        for k, (a, b, book) in enumerate(zip(cut[:-1], cut[1:], self.books, strict=True)):
            s += (book @ q[:, a:b].T)[codes[:, k]]  # whole rows of the table: one entry for all queries
        return np.ascontiguousarray(s.T)


def fit(vectors: DataFrame, sample: int = 65536, lists: int | None = None, parts: int = 16, aim: float = 0.97, k: int = 20, seed: int = 11) -> Index | None:
    """The index of usable vectors; None if there are none."""
    n = vectors.count()
    lists = lists or int(np.clip(np.sqrt(n), 1, max(1, sample // PER_LIST)))
    sample = min(sample, max(16384, PER_LIST * lists))
    unit = 1 << 30
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(unit)) < int(unit * min(1, sample / max(n, 1)))).orderBy("vec_id").toArrow()
    if not rows.num_rows:
        rows = vectors.limit(sample).toArrow()
    if not rows.num_rows:
        return None
    size = rows["embedding"].combine_chunks().value_lengths().to_numpy()
    dim = int(np.bincount(size).argmax())
    x = matrix(rows["embedding"].combine_chunks().filter(pa.array(size == dim)))
    return learned(x, lists, parts, aim, k, seed)


def learned(x: np.ndarray, lists: int, parts: int, aim: float, k: int, seed: int) -> Index:
    """The index from a sample of vectors."""
    dim, rng = x.shape[1], np.random.default_rng(seed)
    centers = k_means(x, lists, rng)
    rest = x - centers[nearest(x, centers)]
    cut = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    books = [k_means(rest[:, a:b], 256, rng) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    index = Index(dim, centers, books, len(centers))
    q = rng.permutation(len(x))[:256]
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-s, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    rank = np.argsort(np.argsort(-(x[q] @ centers.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, nearest(x, centers)[true], axis=1).ravel())
    index.probes = min(len(centers), int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1)
    return index


def _encode(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, codes = index.value.encode(matrix(b.column("embedding")))
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "embedding": b.column("embedding"), "list": pa.array(own.astype(np.int32)), "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    return T.lean(run)


def encode(vectors: DataFrame, index: Index) -> DataFrame:
    """The inverted file, written once: vec_id, embedding, list, code of every usable row."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.filter(F.size("embedding") == index.dim)
    return written(rows.mapInArrow(_encode(vectors.sparkSession.sparkContext.broadcast(index)), f"vec_id long, embedding {kind}, list int, code binary"), "lists")


def _codes(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _true(index, qids: np.ndarray, q: np.ndarray, k: int):
    """Mapper of the inverted file to the task's k best rows of each query: how far, list, and by how much of
    the Cauchy-Schwarz bound its code falls short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = q / np.sqrt((q**2).sum(axis=1, keepdims=True))
        best = np.zeros((3, len(q), 0))
        for b in batches:
            if not b.num_rows:
                continue
            x, own = matrix(b.column("embedding")), b.column("list").to_numpy()
            rest = x - index.value.decoded(own, _codes(b.column("code")))
            size = np.sqrt((rest**2).sum(axis=1, keepdims=True))
            far = np.where(qids[:, None] == b.column("vec_id").to_numpy()[None, :], np.inf, -(q @ x.T))
            of = np.stack([far, np.broadcast_to(own, far.shape), unit @ (rest / np.where(size > 0, size, 1)).T])
            best = np.concatenate([best, of], axis=2)
            if best.shape[2] > k:
                best = np.take_along_axis(best, np.argpartition(best[0], k - 1, axis=1)[None, :, :k], axis=2)
        at, _ = np.nonzero(best[0] < np.inf)
        far, own, short = best[:, best[0] < np.inf]
        yield pa.RecordBatch.from_pydict({"query": pa.array(at.astype(np.int32)), "far": pa.array(far), "list": pa.array(own.astype(np.int32)), "short": pa.array(short)})

    return T.lean(run)


def tuned(index: Index, inverted: DataFrame, queries: DataFrame, k: int = 20, aim: float = 0.97) -> Index:
    """The index with probes and slack for these queries, measured by brute force over every row."""
    tried = queries.filter(F.size("embedding") == index.dim).orderBy(F.xxhash64("vec_id", "embedding")).limit(TRIED).toArrow()
    if not tried.num_rows:
        return index
    qids, q = tried["vec_id"].to_numpy(), matrix(tried["embedding"])
    found = inverted.mapInArrow(_true(inverted.sparkSession.sparkContext.broadcast(index), qids, q, k), "query int, far double, list int, short double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("far", "list", "short"))), 1, k).alias("best")
    rows = found.groupBy("query").agg(best).select("query", F.explode("best").alias("b")).select("query", "b.list", "b.short").toArrow()
    if not rows.num_rows:
        return index
    rank = np.argsort(np.argsort(-(q @ index.centers.T), axis=1, kind="stable"), axis=1)
    at = rows["query"].to_numpy()
    needed = rank[at, rows["list"].to_numpy()] + 1
    share = lambda a, part: int(np.sort(a)[max(0, int(np.ceil(part * len(a))) - 1)])
    each = np.array([share(needed[at == j], 0.9) for j in np.unique(at)])
    return replace(index, probes=max(share(needed, aim), share(each, 0.95)), slack=float(np.clip(np.quantile(np.nan_to_num(rows["short"].to_numpy(), nan=1.0), 0.999), 0, 1)))


def deal(sizes: dict[int, int], n_lists: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each list: long lists are split, short ones share."""
    first, n = np.zeros(n_lists, np.int64), np.ones(n_lists, np.int64)
    at, room = -1, 0
    for k in range(n_lists):
        size = sizes.get(k, 0)
        if size > shard:
            first[k], n[k] = at + 1, -(-size // shard)
            at, room = at + int(n[k]), 0
        else:
            if size > room:
                at, room = at + 1, shard
            first[k], room = max(at, 0), room - size
    return first, n


def _send(index, plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = plan
        shards = int((first + n).max())
        step = max(1, min(1024, (4 << 20) // (shards + 1)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                lists = index.value.probed(matrix(part.column("embedding")))
                wanted = np.zeros((part.num_rows, shards + 1), np.int32)
                for k in range(len(first)):  # +1 where a probed list's shards begin, -1 behind them
                    wanted[:, first[k]] += lists[:, k]
                    wanted[:, first[k] + n[k]] -= lists[:, k]
                row, shard = np.nonzero(np.cumsum(wanted[:, :-1], axis=1))
                for k in range(0, len(row), 4096):
                    taken = part.take(pa.array(row[k : k + 4096]))
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[k : k + 4096].astype(np.int32)), "vec_id": taken.column("vec_id"), "embedding": taken.column("embedding")})

    return T.lean(run)


def _wanted(q: np.ndarray, x: np.ndarray, want: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of the wanted pairs; of many, only those that can be among a query's k best."""
    if want.sum() > want.size // 8 and want.shape[1] > k:
        rough = np.where(want, q @ x.T, -np.inf)
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, [rough.shape[1] - k]]
        want = want & (rough >= edge - 1e-9 * np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1)))
    at, row = np.nonzero(want)
    step = max(1, (1 << 21) // x.shape[1])
    score = [(x[row[j : j + step]] * q[at[j : j + step]]).sum(axis=1) for j in range(0, len(at), step)]
    return at, row, np.concatenate([np.zeros(0), *score])


def _answer(index, k: int):
    def best(ids, x, own, codes, qids, q):
        s = index.value.approximate(q, own, codes)
        s[qids[:, None] == ids[None, :]] = -np.inf
        depth, size = min(3 * k, len(ids)), np.sqrt((q**2).sum(axis=1))[:, None]
        rest, length = np.sqrt(((x - index.value.decoded(own, codes)) ** 2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
        near = np.argpartition(-s, depth - 1, axis=1)[:, :depth] if depth < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
        scores = np.take_along_axis(s, near, axis=1)
        exact = np.sort(np.where(scores > -np.inf, (x[near] * q[:, None, :]).sum(axis=2), -np.inf), axis=1)
        kth = exact[:, [-k]] if depth >= k else np.full((len(q), 1), -np.inf)
        edge = scores.min(axis=1, keepdims=True)
        edge = np.where(edge > -np.inf, edge - 1e-5 * np.abs(edge), edge)  # all rows tied to the last one count
        want = (s > -np.inf) & ((s >= edge) | (s + size * (index.value.slack * rest + 1e-9 * length) >= kth))
        at, row, score = _wanted(q, x, want, k)
        by = np.lexsort((ids[row], -score, at))
        at, row, score = at[by], row[by], score[by]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, row, score = at[kept], row[kept], score[kept]
        first = np.searchsorted(at, np.arange(len(q) + 1)).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids[row])], ["far", "vec_id"])
        return pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(qids), shard_of[0], np.int32)), "query_id": pa.array(qids), "found": pa.ListArray.from_arrays(pa.array(first), found)})

    shard_of = [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held = None, [], None
        for b in batches:
            keys = b.column("shard").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if at == to:
                    continue
                run_of, (own, query) = b.slice(at, to - at), divmod(int(keys[at]), 2)
                if own != shard:
                    shard, parts, held = own, [], None
                    shard_of[0] = own
                x, ids = matrix(run_of.column("embedding")), run_of.column("vec_id").to_numpy()
                if not query:
                    parts.append((ids, x, run_of.column("list").to_numpy(), _codes(run_of.column("code"))))
                elif parts:
                    held = held or tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                    step = min(512, max(16, (4 << 20) // (3 * k * x.shape[1])))  # queries ranked at once
                    for j in range(0, len(ids), step):
                        yield best(*held, ids[j : j + step], x[j : j + step])

    return T.lean(run)


def search(inverted: DataFrame, queries: DataFrame, index: Index, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each usable query."""
    spark = inverted.sparkSession
    sizes = {r.list: r.n for r in inverted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most one row a list
    first, n = deal(sizes, len(index.centers))
    shared = spark.sparkContext.broadcast(index)
    plan = F.array(*map(F.lit, first.tolist())), F.array(*map(F.lit, n.tolist()))
    at = (F.col("list") + 1).cast("int")
    shard = F.element_at(plan[0], at) + F.pmod(F.xxhash64("vec_id"), F.element_at(plan[1], at))
    kind = inverted.schema["embedding"].dataType.simpleString()
    rows = inverted.select(shard.cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "list", "code", "embedding")
    sent = queries.filter(F.size("embedding") == index.dim).mapInArrow(_send(shared, (first, n)), f"shard int, vec_id long, embedding {kind}")
    sent = sent.select("shard", F.lit(1).alias("kind"), "vec_id", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code"), "embedding")
    found = rows.union(sent).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id").mapInArrow(_answer(shared, k), "shard int, query_id long, found array<struct<far: double, vec_id: long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    shards = int((first + n).max())
    while shards > GROUP:
        found = found.groupBy("query_id", F.floor(F.col("shard") / GROUP).cast("int").alias("shard")).agg(best)
        shards = -(-shards // GROUP)
    return found.groupBy("query_id").agg(best).select("query_id", F.posexplode("found").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))
