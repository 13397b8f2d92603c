"""Liveness, victims and packing: what garbage collection would move, as analytics over the log.

Each write gets a page (by order of writing); a page is valid while its row is its key's newest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.merge import numbered_within
from tidelog.operators.read import KEY
from tidelog.schema import GEOMETRY
from tidelog.sources.log import writes


def placed(log: DataFrame, rows_per_segment: int = 256, parts: int = 3) -> DataFrame:
    """Writes with their partition, segment and page; the sequence number is the order of writing."""
    part = F.pmod("inode", F.lit(parts))
    return writes(log).select("seq", "tid", "op", *KEY, "payload", "committed", part.alias("part"), F.floor(F.col("seq") / rows_per_segment).alias("segment"), F.pmod("seq", F.lit(rows_per_segment)).alias("page"))


def _newest(rows: DataFrame, transactions: bool) -> DataFrame:
    """Versions that readers can reach: each key's newest, or (transactions) its newest committed one and
    the newest of each transaction that is open."""
    if not transactions:
        return rows.groupBy(*KEY).agg(F.max("seq").alias("seq"))
    owner = F.when(~F.coalesce("committed", F.lit(False)), F.coalesce("tid", F.lit(-1))).alias("owner")
    return rows.groupBy(*KEY, owner).agg(F.max("seq").alias("seq")).drop("owner")


def live(rows: DataFrame, transactions: bool = False) -> DataFrame:
    """Rows that are still reachable (tombstones included): a semi join with the newest versions.

    transactions: an open transaction's newest version of a key stays beside the newest committed one,
    so collection takes nothing away from it nor from readers that don't see it."""
    return rows.join(_newest(rows, transactions), [*KEY, "seq"], "left_semi")


def dead(rows: DataFrame, transactions: bool = False) -> DataFrame:
    return rows.join(_newest(rows, transactions), [*KEY, "seq"], "left_anti")


def segment_state(rows: DataFrame, transactions: bool = False) -> DataFrame:
    """Valid and invalid pages of each segment."""
    newest = _newest(rows, transactions).withColumnRenamed("seq", "last").withColumn("alive", F.lit(True))
    marked = rows.join(newest, (rows.seq == newest.last) & (rows.inode == newest.inode) & (rows.block == newest.block), "left").select("part", "segment", F.coalesce("alive", F.lit(False)).alias("alive"))
    return marked.groupBy("part", "segment").agg(F.count_if("alive").alias("valid"), F.count_if(~F.col("alive")).alias("invalid"))


def block_index(channel: Column, chip: Column, block: Column, chips: int = 8, blocks: int = 512) -> Column:
    """The number of a block, from its channel, chip and place in the chip."""
    return (channel * chips + chip) * blocks + block


def block_place(index: Column, chips: int = 8, blocks: int = 512) -> Column:
    """struct(channel, chip, block) of a block's number."""
    return F.struct(F.floor(index / (chips * blocks)).alias("channel"), F.pmod(F.floor(index / blocks), F.lit(chips)).alias("chip"), F.pmod(index, F.lit(blocks)).alias("block"))


def victims(state: DataFrame, score: Column | None = None) -> DataFrame:
    """Each partition's segment with most invalid pages, or the greatest score (ties: the oldest); none
    without invalid pages."""
    rank = F.col("invalid") if score is None else score
    best = F.max_by(F.struct("segment", "valid", "invalid"), F.struct(rank.alias("rank"), -F.col("segment"))).alias("v")
    return state.filter("invalid > 0").groupBy("part").agg(best).select("part", "v.*")


def relocated(rows: DataFrame, victim: DataFrame, transactions: bool = False) -> DataFrame:
    """Live rows of victim segments, which collection writes anew."""
    return live(rows, transactions).join(victim.select("part", "segment"), ["part", "segment"], "left_semi")


def without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows outside bad segments."""
    return rows.join(bad.select("segment"), "segment", "left_anti")


def remapped(rows: DataFrame, bad: DataFrame, spares: DataFrame) -> DataFrame:
    """Rows with ``home``, where their segment is: bad segments (segment), in order, go to the spare ones
    (segment), in order; bad ones beyond the spares have no home (null).  The tables of bad and spare
    segments have a row for each such segment."""
    ranked = lambda t: t.select("segment").distinct().withColumn("k", F.row_number().over(Window.orderBy("segment")))
    to = ranked(bad).join(ranked(spares).withColumnRenamed("segment", "spare"), "k", "left").select("segment", "spare", F.lit(True).alias("bad"))
    return rows.join(to, "segment", "left").withColumn("home", F.when(F.col("bad"), F.col("spare")).otherwise(F.col("segment"))).drop("spare", "bad")


def pack(rows: DataFrame, per_page: int, by: str = "inode", order: str | tuple[str, ...] = "seq") -> DataFrame:
    """Rows of each queue dealt to pages in the given order: of arrival, or of logical addresses, as a
    buffer does that sorts before it writes.  The first column of the order is a number."""
    first, *ties = [order] if isinstance(order, str) else order
    placed = numbered_within(rows, by, first, ties=tuple(ties)).withColumn("pos", F.col("pos").cast("int"))
    return placed.withColumn("page_no", F.floor(F.col("pos") / per_page)).withColumn("slot", F.pmod("pos", F.lit(per_page)))


def _walk(pieces: np.ndarray, first: np.ndarray, page: np.ndarray, used: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Packs chunks of values (chunk c from first[c] on) at the same time, from several states each: page and
    used (chunks, states) move on to where the chunks lead.  Page and slot of each value, from the first state."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    page_no, slot = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    p, u = page[order], used[order]
    for j, m in enumerate(np.searchsorted(-size[order], -np.arange(size.max(initial=0))).tolist()):
        at = first[order[:m]] + j
        k = pieces[at][:, None]
        opens = u[:m] + k > capacity
        p[:m] += opens
        u[:m][opens] = 0
        page_no[at], slot[at] = p[:m, 0], u[:m, 0]
        u[:m] = np.minimum(u[:m] + k, capacity)
    page[order], used[order] = p, u
    return page_no, slot


def _changes(t: pa.Table, *names: str) -> np.ndarray:
    """Rows of t at which one of the columns changes, and the first."""
    new = np.arange(t.num_rows) == 0
    for c in (t[name].combine_chunks() for name in names):
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """About so many rows at once, of whole chunks, and where each chunk begins (and the end)."""
    held, n, most = [], 0, rows
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            first = _changes(t, "queue", "chunk")
            if len(first) > 1:
                yield t.slice(0, int(first[-1])), first
            held = t.slice(int(first[-1])).to_batches()
            n = sum(x.num_rows for x in held)
            most = max(rows, 2 * n)  # a long chunk isn't looked through again and again
    if n:
        t = pa.Table.from_batches(held)
        yield t, np.append(_changes(t, "queue", "chunk"), t.num_rows)


def pack_pieces(rows: DataFrame, by: str = "inode", order: str = "seq", capacity: int = GEOMETRY.page_bytes // GEOMETRY.piece_bytes, width: int = 4096) -> DataFrame:
    """Values of several pieces dealt to pages of ``capacity`` pieces: a value larger than the room left
    opens a page (a value larger than a page has one of its own).

    A queue is a state machine over the room left, of which there are capacity + 1 states.  A queue of up to
    ``width`` values is one chunk and begins on an empty page.  A longer one is cut by ``order`` into stretches
    that hold ``width`` values on average; each of these, in parallel, says where it leads from every state;
    these maps, one row a chunk, are followed along the queue.  Then each chunk packs its values.  A task packs
    all its chunks at the same time, value by value."""
    kind = rows.schema[by].dataType.simpleString()
    plain = rows.select(F.col(by).alias("queue"), F.col(order).cast("long").alias("at"), F.col("pieces").cast("int").alias("pieces"))
    long = plain.groupBy("queue").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most")).filter(F.col("n") > width)
    step = F.ceil(F.lit(width) * (F.col("most") - F.col("least") + 1) / F.col("n"))
    long = long.select(F.col("queue").alias("__queue"), "least", F.greatest(step, F.lit(1)).alias("step"))
    chunk = F.coalesce(F.floor((F.col("at") - F.col("least")) / F.col("step")), F.lit(-1)).cast("long").alias("chunk")  # -1: the whole queue
    chunked = plain.join(long, plain.queue.eqNullSafe(long["__queue"]), "left").select("queue", chunk, "at", "pieces")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _chunks(batches):
            page, used = np.zeros((len(first) - 1, capacity + 1), np.int64), np.tile(np.arange(capacity + 1), (len(first) - 1, 1))
            _walk(t["pieces"].to_numpy(), first, page, used, capacity)
            ends = np.arange(0, page.size + 1, capacity + 1, dtype=np.int32)
            at = t.select(["queue", "chunk"]).take(first[:-1]).combine_chunks()
            yield pa.RecordBatch.from_pydict({c: at[c].chunk(0) for c in ("queue", "chunk")} | {"pages": pa.ListArray.from_arrays(ends, page.ravel()), "used": pa.ListArray.from_arrays(ends, used.ravel())})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, page, used = None, 0, 0
        for b in batches:
            starts = []
            for own, pages, ends in zip(b.column("queue").to_pylist(), b.column("pages").to_pylist(), b.column("used").to_pylist(), strict=True):
                if queue is None or queue[0] != own:
                    queue, page, used = (own,), 0, 0
                starts.append((page, used))
                page, used = page + pages[used], ends[used]
            yield pa.RecordBatch.from_pydict({"__queue": b.column("queue"), "__chunk": b.column("chunk"), "page0": pa.array([s[0] for s in starts], pa.int64()), "used0": pa.array([s[1] for s in starts], pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _chunks(batches):
            page, used = (t[c].to_numpy()[first[:-1], None].copy() for c in ("page0", "used0"))
            page_no, slot = _walk(t["pieces"].to_numpy(), first, page, used, capacity)
            out = t.select(["queue", "at", "pieces"]).append_column("page_no", pa.array(page_no.astype(np.int32))).append_column("slot", pa.array(slot.astype(np.int32)))
            yield from out.to_batches(max_chunksize=1 << 14)

    spread = lambda df: df.repartition("queue", "chunk").sortWithinPartitions("queue", "chunk", "at")
    maps = spread(chunked.filter("chunk >= 0")).mapInArrow(lead, f"queue {kind}, chunk long, pages array<long>, used array<long>")
    starts = maps.repartition("queue").sortWithinPartitions("queue", "chunk").mapInArrow(follow, f"__queue {kind}, __chunk long, page0 long, used0 long")
    begun = chunked.join(starts, chunked.queue.eqNullSafe(starts["__queue"]) & (chunked.chunk == starts["__chunk"]), "left")
    begun = begun.select("queue", "chunk", "at", "pieces", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("page0", "used0")))
    placed = spread(begun).mapInArrow(deal, f"queue {kind}, at long, pieces int, page_no int, slot int")
    return placed.select(F.col("queue").alias(by), F.col("at").alias(order), "pieces", "page_no", "slot")


def page_map(log: DataFrame) -> DataFrame:
    """A page mapping: every write of a logical block takes the next page, its old page is invalidated."""
    before = F.lag("seq").over(Window.partitionBy(*KEY).orderBy("seq"))
    return writes(log).select("seq", *KEY, F.col("seq").alias("ppa"), before.alias("invalidated_ppa"))


def valid_bits(rows: DataFrame) -> DataFrame:
    """Valid pages of each segment as a bitmap of four 64-bit words."""
    alive = live(rows).select("segment", F.floor(F.col("page") / 64).alias("word"), F.expr("shiftleft(1L, CAST(page % 64 AS INT))").alias("bit"))
    return alive.groupBy("segment", "word").agg(F.bit_or("bit").alias("bits")).withColumn("valid", F.bit_count("bits").cast("long"))
