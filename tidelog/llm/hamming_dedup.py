"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search.

A document's set holds the hashes of its distinct ``k``-word shingles (words [^\\x20\\x09-\\x0D]+ after
lower-casing A-Z; with fewer words, the whole sequence as one; without words the set is empty and
links with nothing).  Documents link if their sets' Jaccard similarity is at least percent / 100.

1.  Documents with equal sets are one class from here on (by 128 hash bits), whatever their number.
2.  A signature has VALUES MinHash values of 16 bits.  Two signatures differ in about (1 - similarity)
    * VALUES values; the join finds all pairs that differ in at most RADIUS (a pair of similarity 0.8
    exceeds that with a probability of about 3e-5, closer pairs less).
3.  Multi-index: the values are split into CHUNKS chunks.  By the pigeonhole principle a pair within
    RADIUS < CHUNKS * (1 + ERRORS) has a chunk with at most one different value, so the allowed error is
    enumerated: each chunk yields one key for each of its values, made of the others.  All pairs within
    the radius share a key.
4.  No crowded key is expanded into its pairs.  A class's best leader is the smallest class of a key, of
    those the one with which it shares most keys; a link to it is looked for first.  Copies of one text
    become one component here, and a key whose classes are in one component is done with.
5.  A key of at most LIGHT classes gives its pairs of different components.  A key of more (the minima of
    a template or popular passage) is split further, by an exact rule: of two sets that are similar
    enough, the rarest shingles (all but percent / 100 of a set, and one more) have one in common.  So
    the classes of crowded keys meet again by their rarest shingles that two or more of them hold; a
    template's shingles are never among the rarest of texts that differ in more than that.
6.  A shingle of at most LIGHT classes gives its pairs of different components.  What still crowds is
    nearly equal: its classes are compared in blocks of about BLOCK classes and SHINGLES shingles, each
    class outside the shingle's largest component with all others, by products of 0/1 matrices, and
    only links that join components come out.
7.  Pairs of steps 4 to 6 are measured by their signatures; those within the radius are confirmed on the
    full shingle sets of both texts.  Components are contracted in rounds.

Null texts are empty; texts of any length are taken whole.  Rows with a null id take part but name no component unless all ids of theirs
are null (then component_id is null); rows with one id are judged row by row.  Extra columns are
ignored by ``classes`` and kept by ``keep_one``.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm._bloom import bloom, has
from tidelog.llm._components import joined, roots
from tidelog.llm._scratch import written

VALUES, RADIUS, ERRORS, LIGHT, BLOCK, SHINGLES = 96, 35, 1, 32, 256, 1 << 18
CHUNKS = RADIUS // (1 + ERRORS) + 1
_A = T.mix(np.arange(1, VALUES + 1, dtype=T.U64) * T._MUL) | T.U64(1)


def shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted within it; first of each text)."""
    h, first, *_ = T.words_of(col)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out, text = np.zeros(int(count.sum()), T.U64), np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(count) - count
    long = n >= k
    if long.any():
        out[T.spans_index(begin[long], count[long])] = T.hash_ngrams(h, k)[T.spans_index(first[:-1][long], count[long])]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            out[begin[short]] = T.hash_ngrams(h, m)[first[short]]
    order = np.lexsort((out, text))
    out = out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16-bit MinHash values (texts, VALUES) of texts that are not empty; zeros for the others."""
    out = np.zeros((len(first) - 1, VALUES), np.uint16)
    some = np.diff(first) > 0
    at = first[:-1][some]
    if len(at):
        for k in range(VALUES):
            out[some, k] = (T.mix(np.minimum.reduceat(sets * _A[k], at)) & T.U64(0xFFFF)).astype(np.uint16)
    return out


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text", 2 << 20):
                sets, first = shingles(b.column("text"), k)
                wide = signatures(sets, first)
                sums = [T.per_text(T.mix(sets ^ T.U64(s)).view(np.int64), first) for s in (0, 77)]
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(first)) * (VALUES // 4), pa.int32()), pa.array(wide.view(np.int64).ravel()))
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "row": b.column("row"), "n_shingles": pa.array(np.diff(first)), "s1": pa.array(sums[0]), "s2": pa.array(sums[1]), "sig": sig})

    return T.lean(run)


def _keys(passing=None):
    """Rows (key, sid) of signatures: for each chunk and each of its values, the others."""
    bounds = np.linspace(0, VALUES, CHUNKS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sid = b.column("sid").to_numpy()
                v = b.column("sig").flatten().to_numpy().view(np.uint16).reshape(len(sid), VALUES).astype(T.U64) + T.U64(1)
                keys = []
                for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                    for free in range(a, e):
                        h = np.full(len(sid), free, T.U64)
                        for k in range(a, e):
                            if k != free:
                                h = T.mix(h * T._MUL ^ v[:, k])
                        keys.append(h)
                key, own = np.concatenate(keys).view(np.int64), np.tile(sid, VALUES)
                if passing is not None:
                    ok = has(passing.value, key)
                    key, own = key[ok], own[ok]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "sid"])

    return T.lean(run)


def _confirm(k: int, percent: int):
    """Pairs (a, b) whose texts' sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "ta", 1 << 20):
                both = []
                for c in ("ta", "tb"):
                    sets, first = shingles(b.column(c), k)
                    both.append((sets, np.repeat(np.arange(b.num_rows), np.diff(first)), np.diff(first)))
                h, pair = np.concatenate([both[0][0], both[1][0]]), np.concatenate([both[0][1], both[1][1]])
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                shared = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=b.num_rows)
                ok = (100 * shared >= percent * (both[0][2] + both[1][2] - shared)) & (shared > 0)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return T.lean(run)


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of sets (or within one, if right is None), as
    indices into left + right.  Common counts come from products of 0/1 matrices, some columns at a
    time; hashes that only one set has are left out."""
    sets = left + (right or [])
    size = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(column, minlength=len(values)) > 1
    rank = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, start = len(left), 0 if right is None else len(left)
    common = np.zeros((n, len(sets) - start), np.float32)
    for at in range(0, int(often.sum()), 512):
        a, b = np.searchsorted(column, [at, at + 512])
        x = np.zeros((len(sets), 512), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        common += x[:n] @ x[start:].T
    label, out = np.arange(len(sets)), []
    for i in range(n):
        linked = start + np.flatnonzero((100 * common[i] >= percent * (size[i] + size[start:] - common[i])) & (common[i] > 0))
        groups, first = np.unique(label[linked], return_index=True)
        for g, j in zip(groups.tolist(), linked[first].tolist(), strict=True):
            if g != label[i]:
                label[label == g] = label[i]
                out.append((i, j))
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def _compare(k: int, percent: int):
    """Links of tasks (token, i, j) that come sorted, whose rows carry a block (i or j), sid and text."""

    def solve(i: int, rows: list[tuple[int, int, np.ndarray]]):
        sides = [[(s, x) for b, s, x in rows if (b == i) == first] for first in (True, False)]
        sids = np.array([s for side in sides for s, _ in side])
        if sides[0] and (sides[1] or len(sides[0]) > 1):
            one = not sides[1]
            u, v = links_between([x for _, x in sides[0]], None if one else [x for _, x in sides[1]], percent)
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": pa.array(sids[u]), "v": pa.array(sids[v])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for whole in batches:
            for b in T.slices(whole, "text", 1 << 20):
                sets, first = shingles(b.column("text"), k)
                for n, (*own, block, sid) in enumerate(zip(*(b.column(c).to_pylist() for c in ("token", "i", "j", "block", "sid")), strict=True)):
                    if own != task:
                        if held:
                            yield from solve(task[1], held)
                        task, held = own, []
                    held.append((block, sid, sets[first[n] : first[n + 1]]))
        if held:
            yield from solve(task[1], held)

    return T.lean(run)


def _tokens(k: int):
    """Rows (token, sid, size) of the distinct shingles of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text", 1 << 20):
                sets, first = shingles(b.column("text"), k)
                n = np.diff(first)
                yield pa.RecordBatch.from_pydict({"token": pa.array(sets.view(np.int64)), "sid": pa.array(np.repeat(b.column("sid").to_numpy(), n)), "size": pa.array(np.repeat(n, n))})

    return T.lean(run)


def _through(passing, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(has(passing.value, b.column(column).to_numpy())))

    return T.lean(run)


def differing(x, y):
    """Column: how many 16-bit values of two signatures (arrays of longs) differ."""

    def lanes(a, b):
        z = a.bitwiseXOR(b)
        for k in (8, 4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(0x0001000100010001)))

    return F.aggregate(F.zip_with(x, y, lanes), F.lit(0), lambda total, n: total + n)


def _classes(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, row, n_shingles, s1, s2; sets: s1, s2, component, the smallest id and a row of each)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    rows = written(keyed.mapInArrow(_describe(k), f"id {kind}, row long, n_shingles long, s1 long, s2 long, sig array<long>"), "rows")
    one = rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "row")).alias("any"), F.min("id").alias("min_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("named"), F.first("sig").alias("sig"))
    sets = written(one.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "min_id", F.col("named.row").alias("row"), "sig"), "sets")
    sigs = sets.select("sid", "sig")

    # keys of two sets or more, and the sets that have them
    keys = sigs.mapInArrow(_keys(), "key long, sid long").groupBy("key").agg(F.min("sid").alias("lead"), F.max("sid").alias("last"))
    shared = written(keys.filter("lead <> last").select("key", "lead"), "keys")
    passing = spark.sparkContext.broadcast(bloom(shared.select(F.col("key").alias("k"))))
    members = written(sigs.mapInArrow(_keys(passing), "key long, sid long").join(shared, "key"), "members")

    # whole texts of those sets, one row of each
    wanted = members.select("sid").distinct().join(sets.select("sid", "row"), "sid")
    wanted = written(wanted, "wanted")
    passing = spark.sparkContext.broadcast(bloom(wanted.select(F.col("row").alias("k"))))
    texts = written(keyed.select("row", "text").mapInArrow(_through(passing, "row"), "row long, text string").join(wanted, "row").select("sid", "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        of = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"t{c}"))
        return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(_confirm(k, percent), "a long, b long")

    def near(pairs: DataFrame, radius: int) -> DataFrame:
        of = lambda c: sigs.select(F.col("sid").alias(c), F.col("sig").alias(f"g{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").filter(differing(F.col("ga"), F.col("gb")) <= radius).select("a", "b")

    def labelled(t: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
        return t.join(labels.select(F.col("node").alias(column), F.col("comp").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def crowds(placed: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        """placed(by, sid, comp) without groups of one component: those of few rows, and those of many."""
        sums = placed.groupBy(by).agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        sums = written(sums.select(by, "n"), "open")
        return placed.join(sums.filter(F.col("n") <= LIGHT).select(by), by), placed.join(sums.filter(F.col("n") > LIGHT).select(by), by)

    def pairs_of(groups: DataFrame, by: str) -> DataFrame:
        """Pairs of different components of groups of at most LIGHT rows."""
        rows = groups.groupBy(by).agg(F.collect_list(F.struct("sid", "comp")).alias("g"))
        others = lambda x: F.transform(F.filter("g", lambda y: (y["sid"] < x["sid"]) & (y["comp"] != x["comp"])), lambda y: F.struct(x["sid"].alias("a"), y["sid"].alias("b")))
        return rows.select(F.explode(F.flatten(F.transform("g", others))).alias("p")).select("p.*").distinct()

    def linked(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        links = written(confirmed(written(near(written(pairs, "pairs"), RADIUS), "near")), "links")
        return joined(labels, links.toDF("u", "v"))

    # links to best leaders
    shares = members.filter("sid <> lead").groupBy(F.col("sid").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("n"))
    best = written(near(shares.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), RADIUS), "best")
    labels = written(roots(confirmed(best).toDF("node", "up")), "labels")

    # all pairs of small keys
    light, heavy = crowds(written(labelled(members.select("key", "sid"), "sid", labels, "comp"), "placed"), "key")
    labels = linked(labels, pairs_of(light, "key"))

    # classes of crowded keys, by their rarest shingles
    crowd = written(heavy.select("sid").distinct(), "crowd")
    if not crowd.isEmpty():
        held = written(texts.join(crowd, "sid").select("sid", "text").mapInArrow(_tokens(k), "token long, sid long, size long"), "tokens")
        often = written(held.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "often")
        rank = F.row_number().over(Window.partitionBy("sid").orderBy("n", "token")) + F.col("size") - F.count("*").over(Window.partitionBy("sid"))
        prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
        rarest = written(held.join(often, "token"), "shared").withColumn("rank", rank).filter(F.col("rank") <= prefix).select("token", "sid", "size")
        rarest = written(rarest, "rarest")
        light, heavy = crowds(written(labelled(rarest, "sid", labels, "comp"), "placed"), "token")
        labels = linked(labels, pairs_of(light, "token"))

        # what still crowds, in blocks
        parts = labelled(heavy.drop("comp"), "sid", labels, "part")
        sums = written(parts.groupBy("token", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "parts")
        largest = sums.groupBy("token").agg(F.max_by(F.struct("part", "n", "size"), F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > top.n")
        blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / SHINGLES)).cast("int")
        largest = largest.select("token", F.col("top.part").alias("largest"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("p"), blocks(F.col("top.n"), F.col("top.size")).alias("m"))
        open_ = written(parts.drop("size"), "open").join(written(largest, "largest"), "token").withColumn("loose", F.col("part") != F.col("largest"))
        dealt = F.xxhash64("sid")
        block = F.when(F.col("loose"), F.pmod(dealt, "p")).otherwise(F.col("p") + F.pmod(dealt, "m")).cast("int")
        with_loose = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
        with_rest = F.when(F.col("loose"), F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.col("block").alias("i"), (F.col("p") + j).alias("j")))).otherwise(F.array())
        sent = open_.withColumn("block", block).select("token", "sid", "block", F.explode(F.concat(with_loose, with_rest)).alias("pair")).select("token", "pair.i", "pair.j", "block", "sid")
        sent = sent.withColumn("task", F.xxhash64("token", "i", "j")).join(texts, "sid")
        more = sent.repartition("task").sortWithinPartitions("task", "token", "i", "j").mapInArrow(_compare(k, percent), "u long, v long")
        labels = joined(labels, written(more, "links"))

    found = labelled(sets.select("sid", "s1", "s2", "min_id", "row"), "sid", labels, "comp")
    name = found.groupBy("comp").agg(F.min("min_id").alias("component"), F.min_by("row", F.struct(F.col("min_id").isNull(), "min_id", "row")).alias("kept_row"))
    name = written(name, "names")  # so that the next join stands alone and a large component can be split
    return rows, found.join(name, "comp").select("s1", "s2", "component", "kept_row")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest linked id) and kept (it is its own) of every row."""
    rows, sets = _classes(docs, doc_id, text, k, percent)
    found = rows.select("id", "n_shingles", "s1", "s2").join(sets, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns kept: one row of each class of linked rows, and all empty ones."""
    rows, sets = _classes(docs, doc_id, text, k, percent)
    chosen = sets.select(F.col("kept_row").alias("__row")).distinct()
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = docs.filter(~wordless).withColumn("__row", F.xxhash64(F.col(doc_id), F.col(text)))
    return some.join(chosen, "__row").dropDuplicates(["__row"]).drop("__row").union(docs.filter(wordless))
