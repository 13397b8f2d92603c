"""A dictionary model of the store replays the log and must agree with the DataFrames; edge fixtures."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.functions.hashes import murmur3_bytes, mix32, checksum
from tidelog.functions import sizing
from tidelog.operators import gc, hashmap, merge, pages, read, txn, write, caches
from tidelog.plans import compaction
from tidelog.schema import LOG
from tidelog.sources import requests, workloads
from tidelog.sources.log import read_log, writes


def log_of(spark, rows):
    """rows: (seq, op, inode, block, value[, tid])."""
    full = [(r[0], r[5] if len(r) > 5 else r[0] // 16, r[1], r[2], r[3], f"{r[2]:010d}{r[3]:010d}", r[4], f"p{r[0]}", True) for r in rows]
    return spark.createDataFrame(full, LOG)


def test_replay_equals_the_model(spark, sf):
    log = read_log(spark, sf)
    store, status = {}, {}
    for r in sorted(log.collect()):
        k = (r.inode, r.block)
        if r.op != "GET":
            store[k] = None if r.op == "DELETE" else r.value
    for r in log.filter("op = 'GET'").collect():
        k = (r.inode, r.block)
        status[r.seq] = ("NOTFOUND", None) if k not in store else ("DELETED", None) if store[k] is None else ("FOUND", store[k])
    state = read.latest_state(log)
    got = read.point_get(log.filter("op = 'GET'").select("seq", "inode", "block"), state)
    assert {r.seq: (r.status, r.found_value) for r in got.collect()} == status
    assert {(r.inode, r.block): None if r.is_deleted else r.value for r in state.collect()} == store


def test_three_states_and_zero_page(spark):
    log = log_of(spark, [(1, "SET", 1, 1, 5.0), (2, "DELETE", 1, 1, None), (3, "SET", 1, 2, 7.0), (4, "SET", 1, 2, 8.0)])
    asked = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, 1, 3)], "req int, inode long, block long")
    got = {r.req: (r.status, r.found_value) for r in read.point_get(asked, read.latest_state(log)).collect()}
    assert got == {0: ("DELETED", None), 1: ("FOUND", 8.0), 2: ("NOTFOUND", None)}
    got = {r.req: (r.status, r.found_value) for r in read.point_get(asked, read.latest_state(log), zero_deleted=True).collect()}
    assert got == {0: ("FOUND", 0.0), 1: ("FOUND", 8.0), 2: ("NOTFOUND", None)}


def test_cursor_flags(spark):
    log = log_of(spark, [(k, "SET", 7, k, float(k)) for k in range(1, 9)] + [(20 + k, "DELETE", 7, k, None) for k in (2, 3, 4)])
    state = read.latest_state(log)
    blocks = lambda **kw: [r.block for r in read.cursor(state, **kw).orderBy("pos").collect()]
    assert blocks(n=3, start_block=1) == [1, 5, 6]
    assert blocks(n=3, start_block=1, inclusive=False) == [5, 6, 7]
    assert blocks(n=3, start_block=1, filter_first=False) == [1]
    assert [r.has_more for r in read.cursor(state, 5).collect()] == [False] * 5
    assert [r.has_more for r in read.cursor(state, 4).collect()] == [True] * 4
    assert read.range_get(state, "00000000070000000005", 9).count() == 4


def test_key_order_is_unsigned_bytes(spark):
    ks = [b"", b"\x01\xff", b"\x7f", b"\x7f\x00", b"\x80", b"d", b"da"]
    df = spark.createDataFrame([(bytearray(k),) for k in reversed(ks)], "k binary")
    assert [bytes(r.k) for r in df.orderBy("k").collect()] == sorted(ks)
    df = spark.createDataFrame([(5, 300, "name")], "inode long, block long, name string").select(
        keys.encode_data_key(F.col("inode"), F.col("block")).alias("d"), keys.encode_meta_key(F.col("inode"), F.col("name")).alias("m"))
    r = df.select("d", "m", keys.decode_key(F.col("d")).alias("dd"), keys.decode_key(F.col("m")).alias("dm"), keys.has_name(F.col("m"), "name").alias("hit"), keys.successor(F.col("d"), F.lit(2)).alias("s")).first()
    assert bytes(r.d) == b"d" + (5).to_bytes(8, "big") + (300).to_bytes(8, "big") and bytes(r.s)[-8:] == (302).to_bytes(8, "big")
    assert (r.dd.kind, r.dd.inode, r.dd.block, r.dd.name) == ("d", 5, 300, None)
    assert (r.dm.kind, r.dm.inode, r.dm.block, r.dm.name) == ("m", 5, None, "name") and r.hit


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (511, 1), (512, 1), (513, 2)])
def test_pieces(spark, n, want):
    assert spark.range(1).select(write.pieces(F.lit(n))).first()[0] == want


@pytest.mark.parametrize("n", [509, 510, 511, 1021])
def test_segments_cut_at_510(spark, n):
    rows = spark.range(n).select((F.col("id") % 7).alias("inode"), F.col("id").alias("block"), F.col("id").cast("string").alias("key_str"))
    got = sorted(r.n for r in merge.segment_ranges(merge.segments(rows)).collect())
    assert got == sorted([510] * (n // 510) + ([n % 510] if n % 510 else []))
    pos = [r.pos for r in merge.numbered(rows).orderBy("inode", "block").collect()]
    assert pos == list(range(n))


@pytest.mark.parametrize("overlap", [0, 3, 10])
def test_merges_agree(spark, overlap):
    upper = log_of(spark, [(100 + k, "SET", 1, k, 1.0) for k in range(10)])
    lower = log_of(spark, [(k, "SET", 1, k + 10 - overlap, 2.0) for k in range(10)])
    a = {(r.block, r.value) for r in merge.merge(upper, lower).collect()}
    b = {(r.block, r.value) for r in merge.merge_join(upper, lower).collect()}
    assert a == b and len(a) == 20 - overlap
    assert merge.invalidated(upper, lower).count() == overlap
    assert compaction.decide(upper, lower) == ("partial" if overlap else "trivial")
    assert {(r.block, r.value) for r in compaction.level_down(upper, lower, True).collect()} == a
    if overlap:
        with pytest.raises(ValueError):
            merge.concatenate(upper, lower)
        with pytest.raises(Exception, match="duplicate key"):
            merge.union_unique(upper, lower).collect()
    else:
        assert merge.concatenate(upper, lower).count() == 20 and merge.union_unique(upper, lower).count() == 20
    assert compaction.decide(upper, lower.limit(0)) == "empty"


def test_tombstones_go_at_the_last_level_only(spark):
    log = log_of(spark, [(1, "SET", 1, 1, 1.0), (2, "DELETE", 1, 1, None), (3, "SET", 1, 2, 1.0)])
    state = read.latest_state(log)
    assert merge.drop_tombstones(state, False).count() == 2 and merge.drop_tombstones(state, True).count() == 1
    levels = [log_of(spark, [(9, "DELETE", 1, 2, None)]), log_of(spark, [(1, "SET", 1, 2, 1.0), (2, "SET", 1, 3, 1.0)]), log_of(spark, [(0, "SET", 1, 3, 9.0), (0, "SET", 1, 4, 9.0)])]
    assert {(r.block, r.value) for r in compaction.compact_all(levels).collect()} == {(3, 1.0), (4, 9.0)}
    out = compaction.cascade(levels, [0, 5, 9])
    assert [df.count() for df in out] == [0, 2, 2] or out[0].count() == 0


def test_visibility(spark):
    rows = [(1, 1, "SET", True), (2, 1, "SET", False), (3, 3, "SET", False), (4, 2, "SET", False)]
    log = spark.createDataFrame([(s, t, op, 1, 1, "k", float(s), "p", c) for s, t, op, c in rows], LOG)
    seq = lambda **kw: txn.visible(log, **kw).first().seq
    assert seq() == 1 and seq(tid=2) == 4 and seq(isolation="read_uncommitted") == 3
    with pytest.raises(ValueError):
        txn.visible(log, "serializable")


def test_vectors_and_traces_round_trip(spark):
    reqs = [("SET", b"k1", 3, 5, b"hello"), ("GET", b"", None, 9, None), ("RANGEDEL", b"k2", 4, None, None), ("COMMIT", None, None, None, None), ("RMW", b"\xff", 1, 2, b"zz"), ("RANGEGET", b"k", 1, 7, None), ("MGET", b"d" * 17, None, None, None)]
    df = spark.createDataFrame([(bytearray(requests.encode_vector(9, reqs)),), (None,)], "buffer binary")
    got = requests.decode_vectors(df).orderBy("pos").collect()
    assert [(r.op, None if r.key is None else bytes(r.key), r.offset, r.length, None if r.value is None else bytes(r.value)) for r in got] == reqs
    assert {r.tid for r in got} == {9}
    lines = spark.createDataFrame([("4 9",), ("4 1 17 d 5 6 0 10 77",), ("4 1 13 m 5 name 1 10 78",), ("5 22 17 d 1 100 3 0 0",), (" ",)], "value string")
    rows = requests.parse_trace(lines).collect()
    assert [(r.tid, r.type, r.kind, r.block, r.name) for r in rows] == [(4, 9, None, None, None), (4, 1, "d", 6, None), (4, 1, "m", None, "name"), (5, 22, "d", 100, None)]
    assert sorted(r.block for r in requests.expand_mget(requests.parse_trace(lines)).filter("tid = 5").collect()) == [100, 101, 102]
    net = spark.createDataFrame([("1 2 7 0 ab 100",), ("3 2 8 9 cd 0",)], "value string")
    assert [r.value for r in requests.network_trace_lines(requests.parse(net, "network")).collect()] == ["1 2 7 0 ab 100", "3 2 8 9 cd 0"]
    resp = spark.createDataFrame([("*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$2\r\nvv\r\n",), ("*2\r\n$3\r\nget\r\n$1\r\nk\r\n",)], "value string")
    assert [tuple(r) for r in requests.parse(resp, "resp").collect()] == [("SET", "k", "vv"), ("GET", "k", None)]
    with pytest.raises(ValueError):
        requests.parse(net, "smoke signals")


def test_hash_functions(spark):
    assert [murmur3_bytes(b, s) for b, s in ((b"", 0), (b"", 1), (b"hello", 0), (b"hello, world", 0))] == [0, 0x514E28B7, 0x248BFA47, 0x149BBB7F]

    def fmix(h):
        h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ (h >> 16)

    xs = [0, 1, 12345, 0xFFFFFFFF, 0x80000000]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select(mix32(F.col("x"))).collect()
    assert [r[0] for r in got] == [fmix(x) for x in xs]
    import zlib

    r = spark.range(1).select(checksum(F.lit("a" * 300), F.lit(True)), checksum(F.lit("a" * 300), F.lit(False))).first()
    assert tuple(r) == (zlib.crc32(b"a" * 152), zlib.crc32(b"a" * 300))


def test_probing_by_a_model(spark):
    ks = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key_str string")
    placed = hashmap.place(ks, 64, tables=8).collect()
    h = {r.key_str: r.h for r in hashmap.hashed(ks).collect()}
    for t in range(8):
        taken = {}
        for r in sorted((r for r in placed if r.table == t), key=lambda r: r.key_str):
            want = next(((a, c) for c in range(64) if (a := (h[r.key_str] + c + c * c) % 63 + 1) not in taken), (None, 64))
            assert (r.address, r.probes) == want
            taken[want[0]] = 1
    assert len(placed) == 300


def test_packing_by_a_model(spark):
    rows = [(i % 3, i, (i * 7) % 16 + 1) for i in range(60)]
    got = {(r.inode, r.seq): (r.page_no, r.slot) for r in gc.pack_pieces(spark.createDataFrame(rows, "inode long, seq long, pieces long")).collect()}
    for q in range(3):
        page, used = 0, 0
        for _, s, p in (r for r in rows if r[0] == q):
            if used + p > 16:
                page, used = page + 1, 0
            assert got[q, s] == (page, used)
            used += p


def test_caches_by_a_model(spark):
    log = log_of(spark, [(s, "SET" if s % 3 else "GET", 1, (s * 5) % 17, 0.0) for s in range(400)])
    r = caches.simulate_lru(log, capacity=8, shards=1).first()
    order, hits, misses, evicted, dirty = {}, 0, 0, 0, 0
    for s in range(400):
        b, w = (s * 5) % 17, s % 3 != 0
        if b in order:
            hits, w = hits + 1, order.pop(b) or w
        else:
            misses += 1
            if len(order) >= 8:
                evicted, dirty = evicted + 1, dirty + order.pop(next(iter(order)))
        order[b] = w
    assert (r.hits, r.misses, r.evictions, r.dirty) == (hits, misses, evicted, dirty)


def test_bloom_filters_have_no_false_negatives(spark):
    rows = spark.range(2000).select((F.col("id") % 4).alias("segment"), F.concat(F.lit("k"), "id").alias("key_str"))
    filters = pages.bloom_filters(rows)
    assert pages.bloom_probe(rows.join(filters, "segment")).count() == 2000
    others = spark.range(5000, 7000).select((F.col("id") % 4).alias("segment"), F.concat(F.lit("k"), "id").alias("key_str"))
    assert pages.bloom_probe(others.join(filters, "segment")).count() < 200
    free = others.withColumn("filter", F.lit(None).cast("binary"))
    assert pages.bloom_probe(free).count() == 2000


def test_workload_payloads_verify(spark):
    reads = spark.range(10).select(F.concat(F.lit("k"), "id").alias("key_str"), F.col("id").alias("version"))
    good = reads.withColumn("value", workloads.payload(F.col("key_str"), F.col("version")))
    assert workloads.verify(good).count() == 0
    assert workloads.verify(good.withColumn("value", F.when(F.col("version") == 3, "x").otherwise(F.col("value")))).count() == 1
    assert sorted(r.k for r in workloads.permutation(spark, 10, 200).collect()) == list(range(10, 200))


def test_sizing():
    assert 0.009 < sizing.rate_from_memory(1000, 9586) < 0.011
    rates = sizing.level_rates(4, 10, 0.1)
    assert abs(sum(rates) - 0.1) < 1e-12 and all(abs(b / a - 10) < 1e-9 for a, b in zip(rates, rates[1:]))
    f = sizing.size_factor(1_000_000, 1000, 4)
    assert sum(1000 * f**k for k in range(4)) == pytest.approx(1_000_000)
    assert sizing.pinned_size_factor(1_000_000, 1000, 4, 2, 3.0) > 1
    for mode in ("none", "uniform", "fixed", "proportional"):
        plan = sizing.split_memory(4000, [100, 1000, 10000], mode)
        assert len(plan) == 3 and all(p["bytes"] >= 0 for p in plan)


def test_range_delete_and_overlay(spark):
    t = write.range_tombstones(spark.createDataFrame([(5, 1, 10, 3), (6, 1, 0, 0)], "seq long, inode long, block long, n int"))
    assert sorted(r.block for r in t.collect()) == [10, 11, 12]
    state = read.latest_state(log_of(spark, [(1, "SET", 1, 1, 0.0)]))
    p = spark.createDataFrame([(9, 1, 1, 1, "ZZ"), (9, 1, 2, 3, "Q")], "seq long, inode long, block long, offset int, patch string")
    got = {r.block: r.payload for r in write.read_modify_write(p, state, size=6).collect()}
    assert got == {1: "pZZ   ", 2: "   Q  "}


def test_bad_segments_and_endless_workloads(spark, sf):
    rows = gc.placed(read_log(spark, sf))
    bad = spark.createDataFrame([(0,)], "segment long")
    assert gc.without(rows, bad).count() == rows.filter("segment <> 0").count() < rows.count()
    stream = workloads.rate_stream(spark, 0, 100)
    assert stream.isStreaming and stream.columns == ["i", "op", "k", "key_str"]


def test_packed_pages_find_without_decoding(spark, sf):
    state = read.latest_state(read_log(spark, sf)).filter("NOT is_deleted")
    r = state.first()
    assert pages.delta_find(pages.delta_encode(state), r.inode, r.block).count() == 1


def test_writes_are_the_three_kinds(spark, sf):
    assert {r.op for r in writes(read_log(spark, sf)).select("op").distinct().collect()} == {"SET", "RMW", "DELETE"}


def test_placement_grows_with_the_keys(spark):
    n = 2000  # the 16 tables of 63 places x
    ks = spark.range(n).selectExpr("concat('k', id) AS key_str")
    placed = hashmap.place(ks, 128).collect()
    assert len({(r.table, r.address) for r in placed if r.address is not None}) == len(placed) == n
    assert hashmap.tables_for(1500, 128) == 16 and hashmap.tables_for(n, 128) == 32
    assert hashmap.load_factor(ks, 128).first().asDict() == {"filled": n, "tables": 32, "load": n / (128 * 32)}
    with pytest.raises(Exception, match="has no place"):
        hashmap.place(ks, 128, tables=8).collect()


def test_cursor_gives_whole_values(spark):
    state = spark.createDataFrame([(1, 0, "k", 1.0, "v" * 300, False)], "inode long, block long, key_str string, value double, payload string, is_deleted boolean")
    assert [len(read.cursor(state, 5, cut_values=cut).first().payload) for cut in (False, True)] == [300, 152]


def test_deletes_are_seen_by_committed_readers(spark):
    log = log_of(spark, [(1, "SET", 1, 1, 5.0), (2, "SET", 1, 2, 6.0), (3, "SET", 1, 3, 7.0)])
    keys_ = spark.createDataFrame([(1, 1)], "inode long, block long")
    after = write.delete(log, keys_, F.lit(10).cast("long"))
    assert {(r.block, r.op) for r in txn.visible(after).collect()} == {(1, "DELETE"), (2, "SET"), (3, "SET")}
    assert {r.key_str for r in read.latest_state(after).collect()} == {f"{1:010d}{b:010d}" for b in (1, 2, 3)}
    assert {r.tid for r in txn.transactions(after).collect()} == {0}
    ranges = spark.createDataFrame([(10, 1, 2, 2, 7, False)], "seq long, inode long, block long, n int, tid long, committed boolean")
    after = write.append(log, write.range_tombstones(ranges))
    assert {(r.block, r.op) for r in txn.visible(after).collect()} == {(1, "SET"), (2, "SET"), (3, "SET")}
    assert {(r.block, r.op) for r in txn.visible(after, tid=7).collect()} == {(1, "SET"), (2, "DELETE"), (3, "DELETE")}


def test_collection_keeps_what_open_transactions_own(spark):
    rows = [(1, 0, "SET", 1, 1, True), (2, 0, "SET", 1, 1, True), (3, 5, "SET", 1, 1, False), (4, 5, "SET", 1, 1, False), (5, 6, "SET", 1, 1, False), (6, 0, "SET", 2, 1, True)]
    log = spark.createDataFrame([(s, t, op, i, b, f"{i:010d}{b:010d}", 1.0, "p", c) for s, t, op, i, b, c in rows], LOG)
    placed = gc.placed(log)
    assert {r.seq for r in gc.live(placed).collect()} == {5, 6}
    assert {r.seq for r in gc.live(placed, transactions=True).collect()} == {2, 4, 5, 6}
    assert {r.seq for r in gc.dead(placed, transactions=True).collect()} == {1, 3}
    assert sum(r.valid for r in gc.segment_state(placed, transactions=True).collect()) == 4


def test_numbers_with_null_and_crowded_groups(spark):
    rows = [(None, 5), (None, 6), (0, 1), (7, 2)] + [(3, b) for b in range(0, 5000, 2)] + [(2_000_000, 1), (5_000_000_000, 9)]
    got = merge.numbered(spark.createDataFrame(rows, "inode long, block long"), width=64).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.inode, r.block) for r in sorted(got, key=lambda r: r.pos)] == want and [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(len(rows)))


def test_pieces_over_chunks(spark):
    rng = [(1 + k % 3, k, 1 + (k * 7) % 20) for k in range(500)]
    got = {(r.inode, r.seq): (r.page_no, r.slot) for r in gc.pack_pieces(spark.createDataFrame(rng, "inode long, seq long, pieces long"), width=32).collect()}
    at = {}
    for inode, seq, k in rng:
        page, used = at.get(inode, (0, 0))
        if used + k > 16:
            page, used = page + 1, 0
        assert got[inode, seq] == (page, used)
        at[inode] = page, min(16, used + k)


def test_pieces_of_many_short_queues_are_few_groups(spark):
    """Before: a group for nearly every row, as chunks were cut by the whole log's order."""
    rows = [(None if k % 300 == 7 else k % 300, 1000 * k - 10**6, 1 + (k * 7) % 20) for k in range(6000)] + [(1000, k if k < 400 else 10**7 + 40 * k, 1 + k % 5) for k in range(900)]
    packed = gc.pack_pieces(spark.createDataFrame(rows, "inode long, seq long, pieces long"), width=64)
    plan = packed._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan
    got, at = {(r.inode, r.seq): (r.page_no, r.slot) for r in packed.collect()}, {}
    assert len(got) == len(rows)
    for inode, seq, k in sorted(rows, key=lambda r: r[1]):
        page, used = at.get(inode, (0, 0))
        if used + k > 16:
            page, used = page + 1, 0
        assert got[inode, seq] == (page, used)
        at[inode] = page, min(16, used + k)


def test_cache_of_bytes(spark):
    log = log_of(spark, [(k, "SET" if k % 3 else "GET", 1, b, 1.0) for k, b in enumerate([1, 2, 3, 1, 4, 9, 1, 2, 3, 4])])
    r = caches.simulate_lru(log, capacity=10, shards=1, size=F.col("block")).first()
    cache, held, hits, gone, dirty = {}, 0, 0, 0, 0
    for k, b in enumerate([1, 2, 3, 1, 4, 9, 1, 2, 3, 4]):
        hits += b in cache
        was = cache.pop(b, False)
        cache[b] = was or k % 3 > 0
        while sum(cache) > 10:
            dirty += cache.pop(next(iter(cache)))
            gone += 1
    assert (r.hits, r.misses, r.evictions, r.dirty, r.held) == (hits, 10 - hits, gone, dirty, sum(cache))
