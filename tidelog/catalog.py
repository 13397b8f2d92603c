"""Registered queries over the whole driver tables, each with the SQL of the same rows.

``events`` stands for the change log (sources.log), ``lineitem`` for sorted runs on four levels, and
``documents`` for files that are searched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import hashes, keys, sizing
from tidelog.operators import caches, gc, hashmap, merge, pages, read, search, stats, txn, write
from tidelog.plans import compaction
from tidelog.schema import GEOMETRY
from tidelog.sources import requests, workloads
from tidelog.sources.log import read_log, writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOG = """WITH log AS (SELECT event_id AS seq, event_id // 16 AS tid,
  CASE event_type WHEN 'click' THEN 'SET' WHEN 'purchase' THEN 'SET' WHEN 'signup' THEN 'RMW' WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' END AS op,
  user_id AS inode, event_id % 64 AS block, lpad(user_id::VARCHAR, 10, '0') || lpad((event_id % 64)::VARCHAR, 10, '0') AS key_str,
  value, props AS payload, (event_id // 16) % 5 <> 0 AS committed FROM events),
w AS (SELECT * FROM log WHERE op IN ('SET', 'RMW', 'DELETE')),
latest AS (SELECT *, op = 'DELETE' AS is_deleted FROM w QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY seq DESC) = 1),
live AS (SELECT * FROM latest WHERE NOT is_deleted),
placed AS (SELECT seq, op, inode, block, inode % 3 AS part, seq // 256 AS segment, seq % 256 AS page, seq = max(seq) OVER (PARTITION BY inode, block) AS alive FROM w)"""
_RUNS = """WITH runs AS (SELECT l_orderkey % 4 AS level, l_orderkey // (64 << (l_orderkey % 4)::INT) AS run_id, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda j: (ascii(ch)::BIGINT >> j) & 1)))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT) END"


def _times(x: str, y: int) -> str:
    return f"((({x})::HUGEINT * {y}) % 4294967296)::BIGINT"


def _murmur3(key: str, words: int, seed: int) -> str:
    """Murmur3 of ASCII text of a whole number of four-byte words."""
    m = hashes.MURMUR3
    word = "ascii(substr({0}, 4 * i + 1, 1))::BIGINT + ascii(substr({0}, 4 * i + 2, 1)) * 256 + ascii(substr({0}, 4 * i + 3, 1)) * 65536 + ascii(substr({0}, 4 * i + 4, 1)) * 16777216".format(key)
    first = f"list_transform(list_transform(generate_series(0, {words - 1}), lambda i: {_times(word, m['c1'])}), lambda k: {_times('(k * 32768) % 4294967296 + k // 131072', m['c2'])})"
    step = f"(((xor(h, k) * 8192) % 4294967296 + xor(h, k) // 524288) * 5 + {m['n']}) % 4294967296"
    return _mix32(f"xor(list_reduce(list_prepend({seed}::BIGINT, {first}), lambda h, k: {step}), {4 * words}::BIGINT)")


def _mix32(h: str) -> str:
    m = hashes.MURMUR3
    steps = [f"lambda x: {_times('xor(x, x // 65536)', m['f1'])}", f"lambda x: {_times('xor(x, x // 8192)', m['f2'])}", "lambda x: xor(x, x // 65536)"]
    out = f"[({h}) % 4294967296]"
    for f in steps:
        out = f"list_transform({out}, {f})"
    return f"({out})[1]"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.latest_state(read_log(spark, sf_dir))


def _gets(log: DataFrame) -> DataFrame:
    return log.filter("op = 'GET'").select(F.col("seq").alias("req"), "inode", "block")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level's keys cut into sorted runs, twice as wide from level to level."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("level", F.pmod("l_orderkey", F.lit(4)))
    return merge.runs(items.withColumn("run", F.expr("l_orderkey div shiftleft(64L, cast(level AS int))")), "level", "run", "l_orderkey")


# -- lookups and cursors ---------------------------------------------------------------------------


@query(f"{_LOG} SELECT inode, block, op, seq, tid, value, is_deleted FROM latest")
def latest_state(spark, sf_dir):
    return _state(spark, sf_dir).select("inode", "block", "op", "seq", "tid", "value", "is_deleted")


@query(f"""{_LOG} SELECT l.seq AS req, l.inode, l.block, CASE WHEN s.seq IS NULL THEN 'NOTFOUND' WHEN s.is_deleted THEN 'DELETED' ELSE 'FOUND' END AS status,
  CASE WHEN NOT s.is_deleted THEN s.value END AS found_value FROM log l LEFT JOIN latest s USING (inode, block) WHERE l.op = 'GET'""")
def point_get_status(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return read.point_get(_gets(log), read.latest_state(log))


@query(f"""{_LOG} SELECT l.seq AS req, l.inode, l.block, CASE WHEN s.seq IS NULL THEN 'NOTFOUND' ELSE 'FOUND' END AS status,
  CASE WHEN s.is_deleted THEN 0.0::DOUBLE ELSE s.value END AS found_value FROM log l LEFT JOIN latest s USING (inode, block) WHERE l.op = 'GET'""")
def point_get_compat(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return read.point_get(_gets(log), read.latest_state(log), zero_deleted=True)


@query(f"""{_LOG}, wanted AS (SELECT seq AS req, inode, unnest(generate_series(block, block + 7)) AS block, unnest(generate_series(0, 7)) AS pos FROM log WHERE op = 'GET')
SELECT req, pos::INT AS pos, inode, block, coalesce(l.value, 0.0::DOUBLE) AS value FROM wanted LEFT JOIN live l USING (inode, block)""")
def multi_get(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return read.multi_get(_gets(log), read.latest_state(log), 8)


_PAGE = """SELECT inode, row_number() OVER p AS pos, block, key_str, value, substr(payload, 1, 152) AS payload, is_deleted, count(*) OVER (PARTITION BY inode) > {n} AS has_more
  FROM {rows} WHERE block >= 10 WINDOW p AS (PARTITION BY inode ORDER BY block)"""


@query(f"{_LOG}, page AS ({_PAGE.format(rows='live', n=5)}) SELECT inode, pos::INT AS pos, block, key_str, value, payload, has_more FROM page WHERE pos <= 5")
def prefix_scan_kv(spark, sf_dir):
    return read.cursor(_state(spark, sf_dir), 5, start_block=10, cut_values=True)  # as its SQL


@query(f"{_LOG}, page AS ({_PAGE.format(rows='live', n=5)}) SELECT inode, pos::INT AS pos, block, key_str, has_more FROM page WHERE pos <= 5")
def prefix_scan_keys(spark, sf_dir):
    return read.cursor(_state(spark, sf_dir), 5, start_block=10, keys_only=True)


@query(f"{_LOG}, page AS ({_PAGE.format(rows='latest', n=5)}) SELECT inode, pos::INT AS pos, block, key_str, value, payload, has_more FROM page WHERE pos <= 5 AND NOT is_deleted")
def scan_page_compat(spark, sf_dir):
    return read.cursor(_state(spark, sf_dir), 5, start_block=10, filter_first=False, cut_values=True, cap=GEOMETRY.scan_row_cap)


@query(f"{_LOG} SELECT inode, count(*) > 5 AS has_more FROM live WHERE block > 10 GROUP BY inode")
def has_more(spark, sf_dir):
    return read.cursor(_state(spark, sf_dir), 5, start_block=10, inclusive=False, keys_only=True).groupBy("inode").agg(F.bool_or("has_more").alias("has_more"))


@query(f"{_LOG} SELECT key_str, seq, value FROM live WHERE key_str >= '00000000030000000005' AND key_str < '0000000004' ORDER BY key_str LIMIT 20")
def range_get(spark, sf_dir):
    return read.range_get(_state(spark, sf_dir), "00000000030000000005", 20).select("key_str", "seq", "value")


@query(f"""{_LOG}, p AS (SELECT seq AS probe, inode, block FROM log WHERE op = 'GET')
SELECT probe, inode, block, coalesce((SELECT max(k.block) FROM live k WHERE k.inode = p.inode AND k.block <= p.block), (SELECT min(k.block) FROM live k WHERE k.inode = p.inode)) AS floor,
  (SELECT max(k.block) FROM live k WHERE k.inode = p.inode AND k.block <= p.block) AS strict_floor, (SELECT min(k.block) FROM live k WHERE k.inode = p.inode AND k.block >= p.block) AS lower_bound FROM p""")
def floor_lookup(spark, sf_dir):
    log = read_log(spark, sf_dir)
    probes = log.filter("op = 'GET'").select(F.col("seq").alias("probe"), "inode", "block")
    return read.bounds(probes, read.latest_state(log).filter("NOT is_deleted"))


@query(f"{_LOG} SELECT key_str, 'd' AS kind, inode, block, '64' || printf('%016X', inode) || printf('%016X', block) AS key_hex, '64' || printf('%016X', inode) AS prefix_hex FROM live")
def encoded_keys(spark, sf_dir):
    rows = _state(spark, sf_dir).filter("NOT is_deleted").withColumn("key", keys.encode_data_key(F.col("inode"), F.col("block")))
    d = keys.decode_key(F.col("key"))
    return rows.select("key_str", d["kind"].alias("kind"), d["inode"].alias("inode"), d["block"].alias("block"), F.hex("key").alias("key_hex"), F.hex(keys.prefix(F.col("key"))).alias("prefix_hex"))


@query(f"{_LOG} SELECT l.seq, l.key_str FROM log l WHERE l.op = 'GET' AND NOT EXISTS (SELECT 1 FROM latest s WHERE s.inode = l.inode AND s.block = l.block)")
def never_written_reads(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return log.filter("op = 'GET'").join(writes(log).select("inode", "block"), ["inode", "block"], "left_anti").select("seq", "key_str")


@query(f"{_LOG} SELECT inode, block, key_str, value FROM live WHERE inode = 3 AND block > 7 ORDER BY block LIMIT 6")
def iterator_page(spark, sf_dir):
    return read.next_page(_state(spark, sf_dir), 3, 7, 6)


@query(f"{_LOG} SELECT w.inode, w.block, w.seq FROM w JOIN latest USING (seq)")
def pinned_pairs(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return read.still_current(writes(log).select("inode", "block", "seq"), read.latest_state(log))


@query(f"{_LOG} SELECT inode, first(key_str ORDER BY block) AS first_key, first(value ORDER BY block) AS first_value, last(key_str ORDER BY block) AS last_key, count(*) - 1 AS rest FROM live GROUP BY inode")
def pop_min_last(spark, sf_dir):
    """The first row of each prefix, which a pop takes, how many stay, and the last one."""
    return read.ends(_state(spark, sf_dir).filter("NOT is_deleted"))


@query(f"{_LOG} SELECT key_str, 'm' AS kind, inode, 'f' || block AS name, block % 8 = 3 AS hit FROM live")
def named_keys(spark, sf_dir):
    """Meta keys encoded and decoded, and the predicate on their file names."""
    rows = _state(spark, sf_dir).filter("NOT is_deleted").withColumn("key", keys.encode_meta_key(F.col("inode"), F.concat(F.lit("f"), F.col("block").cast("string"))))
    d, hit = keys.decode_key(F.col("key")), F.lit(False)
    for block in range(3, 64, 8):
        hit = hit | keys.has_name(F.col("key"), f"f{block}")
    return rows.select("key_str", d["kind"].alias("kind"), d["inode"].alias("inode"), d["name"].alias("name"), hit.alias("hit"))


# -- changes ---------------------------------------------------------------------------------------


@query(f"""{_LOG}, gone AS (SELECT inode, unnest(generate_series(block, block + 3)) AS block, seq FROM w WHERE op = 'DELETE')
SELECT l.inode, l.block, l.seq, l.value FROM live l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.inode = l.inode AND g.block = l.block AND g.seq > l.seq)""")
def range_delete(spark, sf_dir):
    log = read_log(spark, sf_dir)
    deletes = log.filter("op = 'DELETE'").select("seq", "inode", "block", F.lit(4).alias("n"))
    after = read.latest(write.append(writes(log).filter("op <> 'DELETE'"), write.range_tombstones(deletes)))
    return after.filter("NOT is_deleted").select("inode", "block", "seq", "value")


@query(f"{_LOG} SELECT inode, block, op, seq, tid, key_str FROM w WHERE committed QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY seq DESC) = 1")
def delete_visible_rc(spark, sf_dir):
    """Deletes through the write interface, as committed readers see them."""
    log = read_log(spark, sf_dir)
    deletes = log.filter("op = 'DELETE'").select("inode", "block", "seq", "tid", "committed")
    after = write.delete(writes(log).filter("op <> 'DELETE'"), deletes, F.col("seq"))
    return txn.visible(after).select("inode", "block", "op", "seq", "tid", "key_str")


@query(f"""{_LOG}, gone AS (SELECT seq, tid, 'DELETE' AS op, inode, unnest(generate_series(block, block + 3)) AS block, committed FROM w WHERE op = 'DELETE'),
every AS (SELECT seq, tid, op, inode, block, committed FROM w WHERE op <> 'DELETE' UNION ALL FROM gone)
SELECT inode, block, op, seq, tid, lpad(inode::VARCHAR, 10, '0') || lpad(block::VARCHAR, 10, '0') AS key_str FROM every WHERE committed QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY seq DESC) = 1""")
def txn_range_delete(spark, sf_dir):
    """Range deletes within transactions, as committed readers see them."""
    log = read_log(spark, sf_dir)
    deletes = log.filter("op = 'DELETE'").select("seq", "inode", "block", "tid", "committed", F.lit(4).alias("n"))
    after = write.append(writes(log).filter("op <> 'DELETE'"), write.range_tombstones(deletes))
    return txn.visible(after).select("inode", "block", "op", "seq", "tid", "key_str")


@query(f"""{_LOG}, p AS (SELECT seq, inode, block, block % 16 AS off, 'patch-' || (seq % 100) AS patch FROM log WHERE op = 'RMW'),
b AS (SELECT p.*, rpad(coalesce(l.payload, ''), greatest(64, length(coalesce(l.payload, '')))::INT, ' ') AS base FROM p LEFT JOIN live l USING (inode, block))
SELECT seq, inode, block, substr(base, 1, off) || patch || substr(base, off + length(patch) + 1) AS payload FROM b""")
def rmw_overlay(spark, sf_dir):
    log = read_log(spark, sf_dir)
    patches = log.filter("op = 'RMW'").select("seq", "inode", "block", F.pmod("block", F.lit(16)).cast("int").alias("offset"), F.concat(F.lit("patch-"), F.pmod("seq", F.lit(100)).cast("string")).alias("patch"))
    return write.read_modify_write(patches, read.latest_state(log))


@query(f"{_LOG} SELECT inode, block, length(payload)::BIGINT AS bytes, ((length(payload) + 511) // 512)::BIGINT AS pieces, ((length(payload) + 511) // 512 * 512)::BIGINT AS stored FROM live")
def value_pieces(spark, sf_dir):
    n = F.octet_length("payload").cast("long")
    return _state(spark, sf_dir).filter("NOT is_deleted").select("inode", "block", n.alias("bytes"), write.pieces(n).alias("pieces"), (write.pieces(n) * 512).alias("stored"))


# -- transactions ----------------------------------------------------------------------------------


@query(f"""{_LOG} SELECT inode, block, op, seq, tid FROM w WHERE committed QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY seq DESC) = 1""")
def txn_visible_rc(spark, sf_dir):
    return txn.visible(read_log(spark, sf_dir)).select("inode", "block", "op", "seq", "tid")


@query(f"""{_LOG} SELECT inode, block, op, seq, tid FROM w QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY tid DESC, seq DESC) = 1""")
def txn_visible_ru(spark, sf_dir):
    return txn.visible(read_log(spark, sf_dir), "read_uncommitted").select("inode", "block", "op", "seq", "tid")


_TXN = f"""{_LOG}, t AS (SELECT tid, min(key_str) FILTER (op <> 'GET') AS range_start, max(key_str) FILTER (op <> 'GET') AS range_end, count(*) FILTER (op <> 'GET') AS kv_count,
  count(*) AS requests, min(seq) AS first_seq, max(seq) AS last_seq, bool_and(committed) AS committed FROM log GROUP BY tid),
txns AS (SELECT *, CASE WHEN kv_count = 0 THEN 'EMPTY' WHEN committed THEN 'COMMIT' WHEN kv_count >= 8 THEN 'LOGGED' ELSE 'CACHED' END AS status FROM t)"""


@query(f"{_TXN} SELECT tid, status, range_start, range_end, kv_count, requests, first_seq, last_seq FROM txns")
def txn_table(spark, sf_dir):
    return txn.transactions(read_log(spark, sf_dir)).select("tid", "status", "range_start", "range_end", "kv_count", "requests", "first_seq", "last_seq")


@query(f"{_TXN} SELECT tid, kv_count > 0 AS commitable FROM txns")
def txn_commitable(spark, sf_dir):
    return txn.commitable(txn.transactions(read_log(spark, sf_dir)))


@query(f"{_TXN} SELECT tid, CASE WHEN tid % 2 = 0 THEN CASE status WHEN 'CACHED' THEN 'WAITCOMMIT' WHEN 'LOGGED' THEN 'COMMIT' ELSE status END ELSE status END AS status FROM txns WHERE NOT (tid % 2 = 0 AND status = 'EMPTY')")
def txn_advance(spark, sf_dir):
    table = txn.transactions(read_log(spark, sf_dir))
    return txn.advance(table, table.filter("tid % 2 = 0")).select("tid", "status")


@query(f"{_TXN} SELECT tid, status FROM txns WHERE status IN ('CACHED', 'LOGGED', 'COMMIT', 'CACHEDCOMMIT') AND range_end >= '0000000010'")
def txn_cursor_entries(spark, sf_dir):
    return txn.cursor_entries(txn.transactions(read_log(spark, sf_dir)), "0000000010").select("tid", "status")


@query(f"{_TXN} SELECT tid FROM txns WHERE range_start <= '0000000010' AND range_end >= '0000000010'")
def txn_holders(spark, sf_dir):
    return txn.holders(txn.transactions(read_log(spark, sf_dir)), "0000000010").select("tid")


@query(f"{_LOG} SELECT seq, tid, op, key_str FROM log WHERE tid % 7 <> 3")
def txn_abort(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return txn.abort(log, log.filter("tid % 7 = 3").select("tid").distinct()).select("seq", "tid", "op", "key_str")


@query(f"{_TXN} SELECT min(tid) AS tid FROM txns WHERE status = 'COMMIT'")
def txn_compaction_target(spark, sf_dir):
    return txn.compaction_target(txn.transactions(read_log(spark, sf_dir))).select("tid")


@query(f"{_LOG} SELECT tid, count(*) = 16 AS complete, string_agg(op, ',' ORDER BY seq) AS ops FROM log GROUP BY tid")
def vector_barrier(spark, sf_dir):
    return txn.vectors(read_log(spark, sf_dir)).select("tid", "complete", F.array_join(F.col("requests.op"), ",").alias("ops"))


@query(f"{_LOG} SELECT inode, seq, tid FROM (SELECT *, lag(tid) OVER (PARTITION BY inode ORDER BY seq) AS before FROM w) WHERE before IS NULL OR before <> tid")
def adjacent_tids(spark, sf_dir):
    return txn.adjacent_tids(read_log(spark, sf_dir))


# -- runs, merges, compaction ----------------------------------------------------------------------

_TWO = f"""{_LOG}, lower_run AS (SELECT * FROM w WHERE seq < (SELECT avg(event_id) FROM events) QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY seq DESC) = 1),
upper_run AS (SELECT * FROM w WHERE seq >= (SELECT avg(event_id) FROM events) QUALIFY row_number() OVER (PARTITION BY inode, block ORDER BY seq DESC) = 1)"""


def _two_runs(spark, sf_dir):
    log = writes(read_log(spark, sf_dir))
    half = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.avg("event_id")).scalar()
    one = lambda rows: read.latest(rows).drop("is_deleted").select(*log.columns)
    return one(log.filter(F.col("seq") >= half)), one(log.filter(F.col("seq") < half))


@query(f"{_TWO} SELECT inode, block, coalesce(u.seq, l.seq) AS seq, coalesce(u.op, l.op) AS op FROM upper_run u FULL JOIN lower_run l USING (inode, block)")
def merge_runs(spark, sf_dir):
    return merge.merge(*_two_runs(spark, sf_dir)).select("inode", "block", "seq", "op")


@query(f"{_TWO} SELECT inode, block, coalesce(u.seq, l.seq) AS seq, coalesce(u.op, l.op) AS op FROM upper_run u FULL JOIN lower_run l USING (inode, block)")
def merge_runs_join(spark, sf_dir):
    return merge.merge_join(*_two_runs(spark, sf_dir)).select("inode", "block", "seq", "op")


@query(f"{_TWO} SELECT inode, block, l.seq FROM lower_run l JOIN upper_run u USING (inode, block)")
def merge_invalidated(spark, sf_dir):
    return merge.invalidated(*_two_runs(spark, sf_dir)).select("inode", "block", "seq")


@query(f"{_TWO} SELECT inode, block, coalesce(u.seq, l.seq) AS seq FROM upper_run u FULL JOIN lower_run l USING (inode, block) WHERE coalesce(u.op, l.op) <> 'DELETE'")
def level_down(spark, sf_dir):
    return compaction.level_down(*_two_runs(spark, sf_dir), last_level=True).select("inode", "block", "seq")


@query(f"{_LOG} SELECT inode, block, seq, value FROM live")
def compact_last_level(spark, sf_dir):
    upper, lower = _two_runs(spark, sf_dir)
    return compaction.compact_all([upper, lower]).select("inode", "block", "seq", "value")


_CUT = f"{_LOG}, cut AS (SELECT *, row_number() OVER (ORDER BY inode, block) - 1 AS pos FROM live)"


@query(f"{_CUT} SELECT key_str, pos, pos // 510 AS segment FROM cut")
def segment_cut(spark, sf_dir):
    return merge.segments(_state(spark, sf_dir).filter("NOT is_deleted")).select("key_str", "pos", "segment")


@query(f"{_CUT} SELECT pos // 510 AS segment, min(key_str) AS min_key, max(key_str) AS max_key, count(*) AS n FROM cut GROUP BY 1")
def segment_ranges(spark, sf_dir):
    return merge.segment_ranges(merge.segments(_state(spark, sf_dir).filter("NOT is_deleted")))


@query(f"{_CUT} SELECT pos * 24 // 7040 AS segment, count(*) AS n FROM cut GROUP BY 1")
def segment_cut_bytes(spark, sf_dir):
    return merge.segments_by_bytes(_state(spark, sf_dir).filter("NOT is_deleted")).groupBy("segment").agg(F.count("*").alias("n"))


_ARRIVED = f"{_LOG}, r AS (SELECT seq // 256 AS segment, min(key_str) AS min_key, max(key_str) AS max_key FROM w GROUP BY 1)"


@query(f"{_ARRIVED} SELECT b.segment, b.min_key, a.max_key AS before FROM r a JOIN r b ON b.segment = a.segment + 1 WHERE a.max_key >= b.min_key")
def order_check(spark, sf_dir):
    """Segments in order of writing, which overlap their predecessors."""
    arrived = writes(read_log(spark, sf_dir)).withColumn("segment", F.floor(F.col("seq") / 256))
    return merge.is_ordered(merge.segment_ranges(arrived))


@query(f"{_CUT}, r AS (SELECT pos // 510 AS segment, min(key_str) AS min_key, max(key_str) AS max_key FROM cut GROUP BY 1) SELECT count(*) AS segments, count(*) FILTER (before >= min_key) AS out_of_order FROM (SELECT *, lag(max_key) OVER (ORDER BY segment) AS before FROM r)")
def order_of_sorted(spark, sf_dir):
    """Segments of the sorted state, none of which does."""
    ranges = merge.segment_ranges(merge.segments(_state(spark, sf_dir).filter("NOT is_deleted")))
    bad = merge.is_ordered(ranges).select(F.lit(0).cast("long").alias("segments"), F.lit(1).cast("long").alias("bad"))
    return ranges.select(F.lit(1).cast("long").alias("segments"), F.lit(0).cast("long").alias("bad")).union(bad).agg(F.sum("segments").alias("segments"), F.sum("bad").alias("out_of_order"))


@query(f"{_CUT} SELECT key_str, pos FROM cut WHERE pos = 7")
def nth_key(spark, sf_dir):
    return merge.nth(_state(spark, sf_dir).filter("NOT is_deleted"), 7).select("key_str", "pos")


@query(f"{_LOG} SELECT key_str <= '00000000070000000000' AS upto, count(*) AS n, min(key_str) AS lo, max(key_str) AS hi FROM live GROUP BY 1")
def split_run(spark, sf_dir):
    side = lambda df, flag: df.select(F.lit(flag).alias("upto"), "key_str")
    left, right = merge.split(_state(spark, sf_dir).filter("NOT is_deleted"), "00000000070000000000")
    return side(left, True).union(side(right, False)).groupBy("upto").agg(F.count("*").alias("n"), F.min("key_str").alias("lo"), F.max("key_str").alias("hi"))


@query(f"{_RUNS} SELECT u.run_id AS upper_run, l.run_id AS lower_run FROM runs u JOIN runs l ON u.min_key <= l.max_key AND l.min_key <= u.max_key WHERE u.level = 0 AND l.level = 1")
def run_overlap(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return merge.overlaps(r.filter("level = 0"), r.filter("level = 1"), 128)


@query(f"{_RUNS} SELECT c_custkey AS probe, c_custkey * 7 AS key, level, run_id FROM customer JOIN runs ON c_custkey * 7 BETWEEN min_key AND max_key WHERE level = 2")
def run_prune_lookup(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("probe"), (F.col("c_custkey") * 7).alias("key"))
    return merge.covering_runs(probes, _runs(spark, sf_dir).filter("level = 2"), 256)


@query(f"{_RUNS} SELECT level, count(*) AS runs, min(min_key) AS min_key, max(max_key) AS max_key, sum(n)::BIGINT AS entries, sum(n * 24)::BIGINT AS bytes FROM runs GROUP BY level")
def level_summary(spark, sf_dir):
    return stats.level_summary(_runs(spark, sf_dir))


@query(f"{_RUNS}, s AS (SELECT level, count(*) AS runs, (2 * pow(2, level))::BIGINT AS capacity FROM runs GROUP BY level) SELECT level, runs, capacity FROM s WHERE runs > capacity")
def overfull_levels(spark, sf_dir):
    return compaction.overfull(stats.level_summary(_runs(spark, sf_dir)), 2, 2).select("level", "runs", "capacity")


@query(f"{_LOG} SELECT inode, block, coalesce(c.seq, l.seq) AS seq FROM (SELECT inode, block, max(seq) AS seq FROM w WHERE committed GROUP BY 1, 2) c FULL JOIN (SELECT inode, block, min(seq) AS seq FROM w GROUP BY 1, 2) l USING (inode, block)")
def fill_missing(spark, sf_dir):
    log = writes(read_log(spark, sf_dir)).withColumn("key", F.struct("inode", "block"))
    new = log.filter("committed").groupBy("key").agg(F.max("seq").alias("seq"))
    return merge.fill_missing(new, log.groupBy("key").agg(F.min("seq").alias("seq")), "key", "seq").select("key.inode", "key.block", "seq")


# -- reports ---------------------------------------------------------------------------------------

_US = f"{_LOG}, s AS (SELECT op, tid, seq, floor(abs(value) * 1000)::BIGINT AS us FROM log)"


@query(f"{_US} SELECT op, CASE WHEN us >= 1000000 THEN 11 WHEN us >= 10000 THEN 10 ELSE us // 1000 END::BIGINT AS bucket, count(*) AS n FROM s GROUP BY 1, 2")
def latency_hist(spark, sf_dir):
    return stats.histogram(stats.latencies(read_log(spark, sf_dir)))


@query(f"""{_US}, c AS (SELECT op, us // 10 AS slot, count(*) AS n FROM s GROUP BY 1, 2)
SELECT op, slot, n, (sum(n) OVER r)::BIGINT AS running, (sum(n) OVER r)::BIGINT / (sum(n) OVER (PARTITION BY op))::BIGINT AS share FROM c WINDOW r AS (PARTITION BY op ORDER BY slot ROWS UNBOUNDED PRECEDING)""")
def latency_cdf(spark, sf_dir):
    return stats.cdf(stats.latencies(read_log(spark, sf_dir)))


@query(f"{_US} SELECT op, count(*) AS n, min(us) AS min_us, max(us) AS max_us, sum(us)::BIGINT / count(*) AS avg_us, 100 * count(*) / (SELECT count(*) FROM s) AS percent FROM s GROUP BY op")
def op_type_stats(spark, sf_dir):
    return stats.op_type_stats(stats.latencies(read_log(spark, sf_dir)))


@query(f"""{_US}, g AS (SELECT count(*) AS gets, count(*) FILTER (x.seq IS NOT NULL AND NOT x.is_deleted) AS hits FROM log l LEFT JOIN latest x USING (inode, block) WHERE l.op = 'GET'),
t AS (SELECT count(*) AS requests, count(*) FILTER (op <> 'GET') AS n_writes, (sum(strlen(payload)) FILTER (op IN ('SET', 'RMW')))::BIGINT AS write_bytes, (SELECT sum(us)::BIGINT FROM s) AS total_us FROM log)
SELECT requests, n_writes, write_bytes, gets, hits, requests * 1e6::DOUBLE / total_us AS iops, write_bytes * 1e6::DOUBLE / total_us / 1024 AS kb_s, hits / gets AS success_ratio FROM t, g""")
def throughput_summary(spark, sf_dir):
    log = read_log(spark, sf_dir)
    return stats.throughput(log, read.point_get(_gets(log), read.latest_state(log)))


_WORK = f"""{_TWO}, m AS (SELECT coalesce(u.op, l.op) AS op, u.seq IS NOT NULL AND l.seq IS NOT NULL AS met FROM upper_run u FULL JOIN lower_run l USING (inode, block)),
state AS (SELECT part, segment, count(*) FILTER (alive) AS valid, count(*) FILTER (NOT alive) AS invalid FROM placed GROUP BY 1, 2),
victim AS (SELECT * FROM state WHERE invalid > 0 QUALIFY row_number() OVER (PARTITION BY part ORDER BY invalid DESC, segment) = 1),
moved AS (SELECT p.seq FROM placed p JOIN victim v ON p.part = v.part AND p.segment = v.segment WHERE alive),
work AS (SELECT (SELECT count(*) FROM upper_run) + (SELECT count(*) FROM lower_run) AS merged_in, (SELECT count(*) FROM m WHERE op <> 'DELETE') AS merged_out, (SELECT count(*) FROM m WHERE met) AS replaced,
  (SELECT count(*) FROM m WHERE op = 'DELETE') AS tombstones_dropped, (SELECT count(*) FROM victim) AS victims, (SELECT sum(invalid)::BIGINT FROM victim) AS freed, (SELECT count(*) FROM moved) AS relocated)"""


@query(f"""{_WORK}, a AS (SELECT count(*) FILTER (op <> 'GET') AS user_writes, count(*) FILTER (op = 'GET') AS user_reads, count(*) FILTER (op = 'RMW') AS rmw FROM log),
d AS (SELECT user_writes, user_reads, user_writes + merged_out + relocated AS device_writes, user_reads + rmw + merged_in + relocated AS device_reads FROM a, work)
SELECT *, device_writes / user_writes AS waf, device_reads / user_reads AS raf FROM d""")
def waf_raf(spark, sf_dir):
    return stats.amplification(read_log(spark, sf_dir), _work(spark, sf_dir))


@query(f"{_WORK} SELECT * FROM work")
def store_report(spark, sf_dir):
    """What one merge of two levels and one round of collection read, wrote, dropped and freed."""
    return _work(spark, sf_dir)


def _work(spark, sf_dir):
    placed = gc.placed(read_log(spark, sf_dir))
    return stats.maintenance(*_two_runs(spark, sf_dir), placed, gc.victims(gc.segment_state(placed)))


@query(f"""{_RUNS}, f AS (SELECT level, count(*) AS runs, sum(n)::BIGINT AS entries, (count(*) * 64)::BIGINT AS run_bytes, (sum((ceil(n * ln(0.01) / ln(1 / pow(2, ln(2))))::BIGINT + 7) // 8))::BIGINT AS filter_bytes FROM runs GROUP BY level)
SELECT coalesce(level::VARCHAR, 'all') AS level, sum(runs)::BIGINT AS runs, sum(entries)::BIGINT AS entries, sum(run_bytes)::BIGINT AS run_bytes, sum(filter_bytes)::BIGINT AS filter_bytes, sum(run_bytes + filter_bytes)::BIGINT AS bytes FROM f GROUP BY ROLLUP (level)""")
def level_memory(spark, sf_dir):
    """Memory for run entries and filters of each level, and of all levels."""
    return stats.level_memory(_runs(spark, sf_dir), 0.01)


@query(f"""{_WORK}, m2 AS (SELECT op AS name, count(*) AS n, sum(floor(abs(value) * 1000)::BIGINT)::BIGINT AS us FROM log GROUP BY op)
SELECT * FROM m2 UNION ALL SELECT 'merged_in', merged_in, NULL FROM work UNION ALL SELECT 'merged_out', merged_out, NULL FROM work UNION ALL SELECT 'relocated', relocated, NULL FROM work UNION ALL SELECT 'freed', freed, NULL FROM work""")
def monitor(spark, sf_dir):
    return stats.monitor(read_log(spark, sf_dir), _work(spark, sf_dir))


@query(f"{_LOG} SELECT inode, count(*) AS n, ceil(log2(count(*) + 1))::BIGINT AS height FROM live GROUP BY inode")
def tree_shape(spark, sf_dir):
    return stats.tree_shape(_state(spark, sf_dir).filter("NOT is_deleted"))


@query(f"{_LOG} SELECT inode % 4 AS level, count(*) FILTER (op = 'SET') AS n_set, count(*) FILTER (op = 'GET') AS n_get, count(*) FILTER (op = 'RMW') AS n_rmw, count(*) FILTER (op = 'DELETE') AS n_delete FROM log GROUP BY 1")
def device_traffic(spark, sf_dir):
    return stats.traffic(read_log(spark, sf_dir))


@query(f"{_LOG} SELECT inode, count(*) AS gets, count(*) FILTER (gap <= 256) AS hits FROM (SELECT op, inode, seq - lag(seq) OVER (PARTITION BY inode, block ORDER BY seq) AS gap FROM log) WHERE op = 'GET' GROUP BY inode")
def cache_hits(spark, sf_dir):
    return stats.cache_hits(read_log(spark, sf_dir))


@query(f"{_LOG} SELECT inode, avg(length(payload)) AS avg_length FROM log WHERE op IN ('SET', 'RMW') GROUP BY inode")
def average_value_length(spark, sf_dir):
    return stats.average_value_length(read_log(spark, sf_dir))


# -- garbage collection and packing ----------------------------------------------------------------


@query(f"{_LOG} SELECT part, segment, count(*) FILTER (alive) AS valid, count(*) FILTER (NOT alive) AS invalid FROM placed GROUP BY 1, 2")
def segment_state(spark, sf_dir):
    return gc.segment_state(gc.placed(read_log(spark, sf_dir)))


_VICTIM = f"""{_LOG}, state AS (SELECT part, segment, count(*) FILTER (alive) AS valid, count(*) FILTER (NOT alive) AS invalid FROM placed GROUP BY 1, 2),
victim AS (SELECT * FROM state WHERE invalid > 0 QUALIFY row_number() OVER (PARTITION BY part ORDER BY invalid DESC, segment) = 1)"""


@query(f"{_VICTIM} SELECT part, segment, valid, invalid FROM victim")
def gc_victim(spark, sf_dir):
    return gc.victims(gc.segment_state(gc.placed(read_log(spark, sf_dir))))


@query(f"""{_LOG}, state AS (SELECT part, segment, count(*) FILTER (alive) AS valid, count(*) FILTER (NOT alive) AS invalid FROM placed GROUP BY 1, 2)
SELECT part, segment, valid, invalid FROM state WHERE invalid > 0 QUALIFY row_number() OVER (PARTITION BY part ORDER BY invalid - 2 * valid DESC, segment) = 1""")
def gc_victim_by_score(spark, sf_dir):
    """Victims by a score of the caller's: what is freed less what must be moved."""
    return gc.victims(gc.segment_state(gc.placed(read_log(spark, sf_dir))), F.col("invalid") - 2 * F.col("valid"))


@query(f"{_LOG} SELECT seq, ((seq % 4) * 8 + seq % 8) * 512 + seq % 512 AS idx, seq % 4 AS channel, seq % 8 AS chip, seq % 512 AS block FROM w")
def block_address(spark, sf_dir):
    """Channel, chip and block as one number and back."""
    at = lambda n: F.pmod("seq", F.lit(n))
    rows = writes(read_log(spark, sf_dir)).select("seq", gc.block_index(at(4), at(8), at(512)).alias("idx"))
    return rows.select("seq", "idx", gc.block_place(F.col("idx")).alias("p")).select("seq", "idx", "p.*")


@query(f"{_LOG} SELECT seq, inode, block FROM placed WHERE alive")
def gc_live_pairs(spark, sf_dir):
    return gc.live(gc.placed(read_log(spark, sf_dir))).select("seq", "inode", "block")


@query(f"{_LOG} SELECT seq, inode, block FROM placed WHERE NOT alive")
def gc_dead_pairs(spark, sf_dir):
    return gc.dead(gc.placed(read_log(spark, sf_dir))).select("seq", "inode", "block")


_OPEN = f"{_LOG}, kept AS (SELECT seq, inode, block, inode % 3 AS part, seq // 256 AS segment, row_number() OVER (PARTITION BY inode, block, CASE WHEN NOT committed THEN tid END ORDER BY seq DESC) = 1 AS alive FROM w)"


@query(f"{_OPEN} SELECT seq, inode, block FROM kept WHERE alive")
def gc_open_transactions(spark, sf_dir):
    """What collection must keep while transactions are open."""
    return gc.live(gc.placed(read_log(spark, sf_dir)), transactions=True).select("seq", "inode", "block")


@query(f"{_OPEN} SELECT part, segment, count(*) FILTER (alive) AS valid, count(*) FILTER (NOT alive) AS invalid FROM kept GROUP BY 1, 2")
def segment_state_open(spark, sf_dir):
    return gc.segment_state(gc.placed(read_log(spark, sf_dir)), transactions=True)


@query(f"""{_LOG}, bad AS (SELECT segment, row_number() OVER (ORDER BY segment) AS k FROM (SELECT DISTINCT seq // 256 AS segment FROM w WHERE seq // 256 % 5 = 1)),
spare AS (SELECT i AS spare, i - 999999 AS k FROM range(1000000, 1000000 + (SELECT count(*) // 2 FROM bad)) t(i))
SELECT seq, seq // 256 AS segment, CASE WHEN b.segment IS NULL THEN seq // 256 ELSE spare END AS home FROM w LEFT JOIN bad b ON seq // 256 = b.segment LEFT JOIN spare USING (k)""")
def bad_segment_remap(spark, sf_dir):
    """Bad segments go to spare ones, as many as there are (here half as many)."""
    rows = gc.placed(read_log(spark, sf_dir)).select("seq", "segment")
    bad = rows.filter("segment % 5 = 1").select("segment").distinct()
    spares = bad.withColumn("k", F.row_number().over(Window.orderBy("segment"))).withColumn("half", F.floor(F.count("*").over(Window.partitionBy()) / 2))
    return gc.remapped(rows, bad, spares.filter("k <= half").select((F.col("k") + 999999).cast("long").alias("segment"))).select("seq", "segment", "home")


@query(f"{_VICTIM} SELECT seq, inode, block FROM placed p JOIN victim v ON p.part = v.part AND p.segment = v.segment WHERE alive")
def gc_rewrite(spark, sf_dir):
    rows = gc.placed(read_log(spark, sf_dir))
    return gc.relocated(rows, gc.victims(gc.segment_state(rows))).select("seq", "inode", "block")


@query(f"""{_LOG}, v AS (SELECT segment, page // 64 AS word, count(*) AS valid, sum((1::HUGEINT << (page % 64)::INT)) AS b FROM placed WHERE alive GROUP BY 1, 2)
SELECT segment, word, valid, (CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END)::BIGINT AS bits FROM v""")
def valid_bitmap(spark, sf_dir):
    return gc.valid_bits(gc.placed(read_log(spark, sf_dir))).select("segment", "word", "valid", "bits")


@query(f"{_LOG}, p AS (SELECT seq, inode, row_number() OVER (PARTITION BY inode ORDER BY seq) - 1 AS pos FROM w) SELECT seq, inode, pos::INT AS pos, pos // 16 AS page_no, (pos % 16)::INT AS slot FROM p")
def page_packing(spark, sf_dir):
    return gc.pack(writes(read_log(spark, sf_dir)).select("seq", "inode"), 16)


@query(f"{_LOG}, p AS (SELECT seq, inode, block, row_number() OVER (PARTITION BY inode ORDER BY block, seq) - 1 AS pos FROM w) SELECT seq, inode, block, pos::INT AS pos, pos // 16 AS page_no, (pos % 16)::INT AS slot FROM p")
def page_packing_by_address(spark, sf_dir):
    """Writes sorted by logical address before they are packed."""
    return gc.pack(writes(read_log(spark, sf_dir)).select("seq", "inode", "block"), 16, order=("block", "seq"))


@query(f"""{_LOG.replace("WITH log", "WITH RECURSIVE log")}, q AS (SELECT seq, inode, (seq % 7 + 1)::INT AS pieces, row_number() OVER (PARTITION BY inode ORDER BY seq) AS k FROM w),
f AS (SELECT seq, inode, pieces, k, 0 AS page_no, 0 AS slot FROM q WHERE k = 1
  UNION ALL SELECT q.seq, q.inode, q.pieces, q.k, CASE WHEN f.slot + f.pieces + q.pieces > 16 THEN f.page_no + 1 ELSE f.page_no END, CASE WHEN f.slot + f.pieces + q.pieces > 16 THEN 0 ELSE f.slot + f.pieces END FROM f JOIN q ON q.inode = f.inode AND q.k = f.k + 1)
SELECT seq, inode, pieces, page_no, slot FROM f""")
def piece_packing(spark, sf_dir):
    rows = writes(read_log(spark, sf_dir)).select("seq", "inode", (F.pmod("seq", F.lit(7)) + 1).alias("pieces"))
    return gc.pack_pieces(rows, width=512)


@query(f"{_LOG} SELECT seq, inode, block, seq AS ppa, lag(seq) OVER (PARTITION BY inode, block ORDER BY seq) AS invalidated_ppa FROM w")
def page_map(spark, sf_dir):
    return gc.page_map(read_log(spark, sf_dir))


# -- encodings and hashes --------------------------------------------------------------------------


@query(f"{_LOG} SELECT inode, block, min(block) OVER (PARTITION BY inode) AS base, block - min(block) OVER (PARTITION BY inode) AS delta FROM live")
def delta_encode(spark, sf_dir):
    return pages.delta_encode(_state(spark, sf_dir).filter("NOT is_deleted"))


@query(f"{_CUT} SELECT pos // 510 AS segment, (pos % 510)::INT AS at, key_str || '@' || pos AS seen FROM cut")
def visited_keys(spark, sf_dir):
    """A visitor over the keys of packed segments."""
    packed = pages.pack_keys(merge.segments(_state(spark, sf_dir).filter("NOT is_deleted")))
    return pages.visit_keys(packed, lambda k: F.concat_ws("@", k["key_str"], k["pos"].cast("string")))


@query(f"""{_LOG.replace("WITH log", "WITH RECURSIVE log")}, k AS (SELECT inode, block, row_number() OVER (PARTITION BY inode ORDER BY block) - 1 AS pos, count(*) OVER (PARTITION BY inode) AS n FROM live),
walk AS (SELECT DISTINCT inode, n, 1::BIGINT AS node FROM k UNION ALL SELECT inode, n, 2 * node + c FROM walk, (VALUES (0), (1)) t(c) WHERE 2 * node + c <= n),
spelt AS (SELECT inode, node, rpad(replace(replace(substr(bin(node), 2), '0', 'a'), '1', 'c'), 40, 'b') AS way FROM walk),
inorder AS (SELECT inode, node, row_number() OVER (PARTITION BY inode ORDER BY way) - 1 AS pos FROM spelt)
SELECT inode, block, pos, node FROM k JOIN inorder USING (inode, pos)""")
def search_layout(spark, sf_dir):
    """Keys of each prefix in the layout of a complete search tree (its SQL walks the tree in order)."""
    live = _state(spark, sf_dir).filter("NOT is_deleted")
    placed = merge.numbered_within(live, "inode", "block").join(live.groupBy("inode").agg(F.count("*").alias("n")), "inode")
    return pages.search_layout(placed, F.col("n")).select("inode", "block", "pos", "node")


@query(f"{_LOG} SELECT inode, block FROM live")
def delta_decode(spark, sf_dir):
    return pages.delta_decode(pages.delta_encode(_state(spark, sf_dir).filter("NOT is_deleted")))


@query(f"{_CUT} SELECT pos // 510 AS segment, key_str, pos FROM cut")
def packed_keys(spark, sf_dir):
    return pages.unpack_keys(pages.pack_keys(merge.segments(_state(spark, sf_dir).filter("NOT is_deleted"))))


@query(f"{_LOG} SELECT seq, {_crc32('CASE WHEN block % 2 = 0 THEN substr(payload, 1, 152) ELSE payload END')} AS crc FROM log")
def crc_check(spark, sf_dir):
    return read_log(spark, sf_dir).select("seq", hashes.checksum(F.col("payload"), F.pmod("block", F.lit(2)) == 0).alias("crc"))


@query(f"{_LOG} SELECT seq, sha256(key_str) AS digest FROM log")
def sha256_digest(spark, sf_dir):
    return read_log(spark, sf_dir).select("seq", F.sha2(F.col("key_str").cast("binary"), 256).alias("digest"))


_FOLD = "xor(xor(xor({0}, {1}), xor({2}, {3})), xor(xor({4}, {5}), xor({6}, {7})))".format(*(f"('0x' || substr(sha256(key_str), {8 * k + 1}, 8))::BIGINT" for k in range(8)))


@query(f"{_LOG} SELECT DISTINCT key_str, {_FOLD} AS h FROM live")
def sha_fold(spark, sf_dir):
    return hashmap.hashed(_state(spark, sf_dir).filter("NOT is_deleted").select("key_str"))


@query(f"{_LOG}, a AS (SELECT key_str, {_FOLD} % 4095 + 1 AS address FROM live) SELECT key_str, address, count(*) OVER (PARTITION BY address) AS n FROM a")
def hash_probe_first(spark, sf_dir):
    return hashmap.first_probe(_state(spark, sf_dir).filter("NOT is_deleted").select("key_str"), 4096).select("key_str", "address", "n")


#: Keys inserted one by one, a step for each place in the order of their table.
_PLACED = f"""{_LOG.replace("WITH log", "WITH RECURSIVE log")}, many AS (SELECT (16 * pow(2, greatest(0, ceil(log2(count(*) / (0.75 * 16 * 4095))))))::BIGINT AS tables FROM live),
dealt AS (SELECT key_str, {_FOLD} AS h, ('0x' || substr(md5(key_str), 1, 8))::BIGINT % tables AS tab FROM live, many),
o AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY key_str) AS k FROM dealt),
ins AS (SELECT tab, k, key_str, [h % 4095 + 1] AS taken, 0::BIGINT AS probes FROM o WHERE k = 1
  UNION ALL SELECT o.tab, o.k, o.key_str, list_append(i.taken, (o.h + c.c + c.c * c.c) % 4095 + 1), c.c FROM ins i JOIN o ON o.tab = i.tab AND o.k = i.k + 1,
  LATERAL (SELECT list_filter(generate_series(0, 255), lambda x: NOT list_contains(i.taken, (o.h + x + x * x) % 4095 + 1))[1] AS c) c),
put AS (SELECT key_str, tab AS "table", taken[-1] AS address, probes FROM ins)"""


@query(f'{_PLACED} SELECT key_str, "table", address, probes FROM put')
def hash_placement(spark, sf_dir):
    return hashmap.place(_state(spark, sf_dir).filter("NOT is_deleted"), 4096)


@query(f"{_PLACED}, c AS (SELECT probes, count(*) AS n FROM put GROUP BY 1) SELECT probes, n, (sum(n) OVER (ORDER BY probes))::BIGINT / (sum(n) OVER ())::BIGINT AS share FROM c")
def hash_collision_cdf(spark, sf_dir):
    return hashmap.collision_cdf(hashmap.place(_state(spark, sf_dir).filter("NOT is_deleted"), 4096))


@query(f"{_LOG}, many AS (SELECT count(*) AS n, (16 * pow(2, greatest(0, ceil(log2(count(*) / (0.75 * 16 * 4095))))))::BIGINT AS tables FROM live) SELECT n AS filled, tables, n / (4096 * tables) AS load FROM many")
def hash_load_factor(spark, sf_dir):
    return hashmap.load_factor(_state(spark, sf_dir).filter("NOT is_deleted"), 4096)


@query(f"{_LOG} SELECT DISTINCT inode::VARCHAR AS name, list_reduce(list_prepend(5361::BIGINT, list_transform(string_split(inode::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) AS h FROM log")
def string_hash(spark, sf_dir):
    names = read_log(spark, sf_dir).select(F.col("inode").cast("string").alias("name")).distinct()
    return names.select("name", hashes.string_hash(F.col("name")).alias("h"))


@query(f"{_LOG} SELECT key_str, {_murmur3('key_str', 5, 2)} AS h, {_mix32('seq')} AS mixed FROM latest")
def murmur_hash(spark, sf_dir):
    return _state(spark, sf_dir).select("key_str", hashes.murmur3(2)(F.col("key_str").cast("binary")).alias("h"), hashes.mix32(F.col("seq")).alias("mixed"))


@query(f"""{_CUT}, s AS (SELECT pos // 510 AS segment, key_str FROM cut), r AS (SELECT segment, min(key_str) AS lo, max(key_str) AS hi FROM s GROUP BY 1),
p AS (SELECT key_str, {_murmur3('key_str', 5, 2)} AS a, {_murmur3('key_str', 5, 3)} AS b FROM (SELECT DISTINCT key_str FROM log)),
spots AS (SELECT key_str, unnest(list_transform([0, 1, 2, 3, 4, 5], lambda i: (a + i * (b | 1)) % 8192)) AS bit FROM p),
bits AS (SELECT DISTINCT segment, bit FROM s JOIN spots USING (key_str)),
asked AS (SELECT segment, o.key_str, bit FROM spots o JOIN r ON o.key_str BETWEEN lo AND hi)
SELECT segment, key_str FROM asked LEFT JOIN bits b USING (segment, bit) GROUP BY 1, 2 HAVING count(*) = count(b.bit)""")
def bloom_prune(spark, sf_dir):
    """Segments that a Bloom filter can't rule out, for every key of the log."""
    log = read_log(spark, sf_dir)
    cut = merge.segments(read.latest_state(log).filter("NOT is_deleted"))
    ranges = merge.segment_ranges(cut).select("segment", "min_key", "max_key")
    probes = log.select("key_str").distinct()
    prefix = lambda c: F.substring(c, 1, 10).cast("long")
    wide = ranges.select("segment", "min_key", "max_key", F.explode(F.sequence(prefix("min_key"), prefix("max_key"))).alias("p"))
    near = probes.withColumn("p", prefix("key_str")).join(wide, "p").filter("key_str BETWEEN min_key AND max_key").select("segment", "key_str")
    return pages.bloom_probe(near.join(pages.bloom_filters(cut), "segment"))


@query(f"""{_RUNS} SELECT level, run_id, n, ceil(n * ln(0.01) / ln(1 / pow(2, ln(2))))::BIGINT AS bits, round(ln(2) * ceil(n * ln(0.01) / ln(1 / pow(2, ln(2)))) / n)::BIGINT AS hashes FROM runs""")
def bloom_sizing(spark, sf_dir):
    bits = sizing.bloom_bits(F.col("n"), 0.01)
    return _runs(spark, sf_dir).select("level", "run_id", "n", bits.cast("long").alias("bits"), sizing.bloom_hashes(F.col("n"), bits).alias("hashes"))


@query("SELECT doc_id, len(list_filter(generate_series(1, length(text)), lambda i: substr(text, i, 3) = 'ana'))::BIGINT AS n FROM documents")
def substring_count(spark, sf_dir):
    return search.substring_count(spark.read.parquet(f"{sf_dir}/documents.parquet"), "ana", "doc_id")


# -- sources and generators ------------------------------------------------------------------------


@query(f"""{_LOG} SELECT seq, concat_ws(' ', tid, CASE op WHEN 'SET' THEN 1 WHEN 'GET' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'RMW' THEN 7 END, 17, 'd', inode, block, 0, length(payload), {_crc32('payload')}) AS line FROM log""")
def trace_lines(spark, sf_dir):
    return requests.trace_lines(read_log(spark, sf_dir)).select("seq", "line")


@query(f"{_LOG} SELECT tid, CASE op WHEN 'SET' THEN 1 WHEN 'GET' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'RMW' THEN 7 END::INT AS type, inode, block, length(payload)::INT AS length FROM log")
def trace_round_trip(spark, sf_dir):
    lines = requests.trace_lines(read_log(spark, sf_dir))
    return requests.parse_trace(lines, "line").select("tid", "type", "inode", "block", "length")


@query(f"{_LOG} SELECT tid, (seq % 16)::INT AS pos, op, key_str, CASE WHEN op IN ('SET', 'RMW') THEN (seq % 32)::INT END AS \"offset\", CASE WHEN op <> 'DELETE' THEN length(payload)::INT END AS length, CASE WHEN op IN ('SET', 'RMW') THEN payload END AS value FROM log")
def vector_round_trip(spark, sf_dir):
    """Requests of each transaction as one binary vector, decoded again."""
    log = read_log(spark, sf_dir).withColumn("offset", F.pmod("seq", F.lit(32)).cast("int"))
    rows = requests.decode_vectors(requests.encode_vectors(log))
    return rows.select("tid", "pos", "op", F.decode("key", "UTF-8").alias("key_str"), "offset", "length", F.decode("value", "UTF-8").alias("value"))


@query(f"{_LOG} SELECT inode, block, seq FROM latest")
def map_union(spark, sf_dir):
    """Maps of disjoint keys in one; a key that both had would raise an error."""
    state = _state(spark, sf_dir).select("inode", "block", "seq")
    return merge.union_unique(state.filter("inode % 2 = 0"), state.filter("inode % 2 = 1"))


@query(f"{_LOG} SELECT key_str, seq FROM latest")
def level_concatenate(spark, sf_dir):
    """Levels of disjoint ranges, moved without a merge."""
    state = _state(spark, sf_dir).select("key_str", "seq")
    left, right = merge.split(state, "00000000070000000000")
    return merge.concatenate(left, right)


@query(f"{_LOG} SELECT inode, block, seq FROM live WHERE block = 9")
def delta_lookup(spark, sf_dir):
    """Keys found in delta-encoded pages without decoding them."""
    rows = _state(spark, sf_dir).filter("NOT is_deleted")
    return pages.delta_find(pages.delta_encode(rows, "seq"), None, 9).select("inode", (F.col("base") + F.col("delta")).alias("block"), "seq")


@query(f"{_LOG} SELECT tid, count(*) AS requests, count(DISTINCT key_str) FILTER (op <> 'GET') AS kv_count, max(seq) AS last_seq FROM log GROUP BY tid HAVING count(*) >= 16")
def write_buffers(spark, sf_dir):
    """Buffers of whole transactions, which are flushed when their vector is complete."""
    return txn.buffers(read_log(spark, sf_dir), 16)


@query("""SELECT level, keys, CASE WHEN mode = 'uniform' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS rate, ceil(-keys * ln(CASE WHEN mode = 'uniform' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END) / pow(ln(2), 2) / 8)::BIGINT AS bytes, mode,
  sum(-keys * ln(CASE WHEN mode = 'uniform' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END) / pow(ln(2), 2) / 8) OVER (PARTITION BY mode ORDER BY level) <= 100000 AS pinned
FROM (SELECT l_orderkey % 4 AS level, count(*) AS keys FROM lineitem GROUP BY 1), (VALUES ('uniform'), ('fixed')) m(mode)""")
def filter_memory(spark, sf_dir):
    """Filter bytes of the levels and which of them fit into the memory."""
    levels = sorted((r.level, r.n) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.pmod("l_orderkey", F.lit(4)).alias("level")).agg(F.count("*").alias("n")).collect())  # a row a level
    rows = [(level, n, r["rate"], r["bytes"], mode, r["pinned"]) for mode in ("uniform", "fixed") for (level, n), r in zip(levels, sizing.split_memory(100000, [n for _, n in levels], mode), strict=True)]
    return spark.createDataFrame(rows, "level long, keys long, rate double, bytes long, mode string, pinned boolean")


@query("""WITH f AS (SELECT total, levels, CASE levels WHEN 2 THEN total / 64 - 1 ELSE (sqrt(1 - 4 * (1 - total / 64)) - 1) / 2 END AS factor FROM (SELECT count(*) * k AS total FROM lineitem, (VALUES (1), (3), (10)) t(k) GROUP BY k), (VALUES (2), (3)) l(levels))
SELECT total, levels::BIGINT AS levels, round(factor, 6) AS factor, round(0.05 / (1 + factor + CASE levels WHEN 3 THEN factor * factor ELSE 0 END), 9) AS first_rate FROM f""")
def level_sizing(spark, sf_dir):
    """The growth of levels that hold a table, and the filter rate of the first of them."""
    n, rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), []
    for total in (n, 3 * n, 10 * n):
        for levels in (2, 3):
            factor = sizing.size_factor(total, 64, levels)
            rows.append((total, levels, round(factor, 6), round(sizing.level_rates(levels, factor, 0.05)[0], 9)))
    return spark.createDataFrame(rows, "total long, levels long, factor double, first_rate double")


@query(f"""{_LOG} SELECT seq AS cookie, CASE op WHEN 'GET' THEN 'READ' WHEN 'DELETE' THEN 'TRIM' WHEN 'RMW' THEN 'FLUSH' ELSE 'WRITE' END AS op, block * 4096 + seq % 512 AS "offset", length(payload) * 512 AS length,
  block + (seq % 512) // 4096 AS first_page, CASE WHEN op = 'RMW' THEN 0 ELSE (block * 4096 + seq % 512 + length(payload) * 512 - 1) // 4096 - block + 1 END AS pages, CASE WHEN op = 'SET' THEN payload ELSE '' END AS payload FROM log""")
def block_commands(spark, sf_dir):
    """Requests as frames of a network block device, decoded again."""
    kind = F.when(F.col("op") == "GET", "READ").when(F.col("op") == "DELETE", "TRIM").when(F.col("op") == "RMW", "FLUSH").otherwise("WRITE")
    rows = read_log(spark, sf_dir).select(F.col("seq").alias("cookie"), kind.alias("op"), (F.col("block") * 4096 + F.pmod("seq", F.lit(512))).alias("offset"), (F.length("payload") * 512).alias("length"), "payload")
    return requests.decode_block_commands(requests.encode_block_commands(rows)).withColumn("payload", F.decode("payload", "UTF-8"))


@query(f"{_LOG} SELECT op, count(*) AS n FROM log GROUP BY op")
def op_mix(spark, sf_dir):
    return read_log(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"))


@query(f"""{_LOG} SELECT seq, CASE op WHEN 'SET' THEN 'DATA_SET' WHEN 'GET' THEN 'META_GET' WHEN 'DELETE' THEN 'DATA_DEL' ELSE 'META_UPDATE' END AS file_op, op,
  CASE op WHEN 'SET' THEN 1 WHEN 'GET' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'RMW' THEN 7 END::INT AS opcode FROM log""")
def op_translation(spark, sf_dir):
    name = F.when(F.col("op") == "SET", "DATA_SET").when(F.col("op") == "GET", "META_GET").when(F.col("op") == "DELETE", "DATA_DEL").otherwise("META_UPDATE")
    return requests.translate(read_log(spark, sf_dir).select("seq", name.alias("file_op")))


_DRAW = "('0x' || substr(md5('{seed}-' || i), 1, 8))::BIGINT % {below}"


def _generated(op: str, k: str, n: int) -> str:
    return f"SELECT i, {op} AS op, ({k})::BIGINT AS k, lpad(({k})::BIGINT::VARCHAR, 20, '0') AS key_str FROM range({n}) t(i)"


@query(_generated("'SET'", "5 + i % 1000", 5000))
def workload_sequential(spark, sf_dir):
    return workloads.sequential(spark, 5000, 5, 1005)


@query(_generated("CASE WHEN i < 2500 THEN 'SET' ELSE 'GET' END", "5 + i % 2500 % 1000", 5000))
def workload_sequential_rw(spark, sf_dir):
    return workloads.sequential_rw(spark, 5000, 5, 1005)


@query(_generated("'SET'", "5 + " + _DRAW.format(seed=1, below=1000), 5000))
def workload_uniform(spark, sf_dir):
    return workloads.uniform(spark, 5000, 5, 1005)


@query(_generated("CASE WHEN i < 2500 THEN 'SET' ELSE 'GET' END", "5 + " + _DRAW.format(seed=1, below=1000).replace("|| i)", "|| i % 2500)"), 5000))
def workload_uniform_rw(spark, sf_dir):
    return workloads.uniform_rw(spark, 5000, 5, 1005)


@query(_generated(f"CASE WHEN {_DRAW.format(seed=2, below=100)} < 70 THEN 'SET' ELSE 'GET' END", "5 + " + _DRAW.format(seed=1, below=1000), 5000))
def workload_mixed(spark, sf_dir):
    return workloads.mixed(spark, 5000, 5, 1005, 70)


@query(_generated("'SET'", "5 + i", 1000))
def workload_permutation(spark, sf_dir):
    return workloads.permutation(spark, 5, 1005)


@query(_generated("'GET'", f"5 + CASE WHEN {_DRAW.format(seed=2, below=100)} < 90 THEN {_DRAW.format(seed=1, below=100)} ELSE {_DRAW.format(seed=1, below=1000)} END", 5000))
def workload_locality(spark, sf_dir):
    return workloads.locality(spark, 5000, 5, 1005)


@query(f"""WITH g AS ({_generated(f"CASE WHEN {_DRAW.format(seed=2, below=100)} < 50 THEN 'SET' ELSE 'GET' END", "5 + " + _DRAW.format(seed=1, below=1000), 5000)})
SELECT i, op, k, key_str FROM g WHERE op = 'SET' OR EXISTS (SELECT 1 FROM g w WHERE w.op = 'SET' AND w.k = g.k AND w.i < g.i)""")
def workload_latency(spark, sf_dir):
    return workloads.latency(spark, 5000, 5, 1005)


@query("""WITH g AS (SELECT i, i // 629 AS tid, lpad((5 + i % 1000)::VARCHAR, 20, '0') AS key_str FROM range(5000) t(i))
SELECT tid, tid // 2 AS term, 'SET' AS op, key_str, i FROM g UNION ALL SELECT DISTINCT tid, tid // 2, 'BEGIN', NULL, -1 FROM g UNION ALL SELECT DISTINCT tid, tid // 2, 'COMMIT', NULL, 4611686018427387904 FROM g""")
def workload_transactions(spark, sf_dir):
    return workloads.transactions(workloads.sequential(spark, 5000, 5, 1005)).select("tid", "term", "op", "key_str", "i")


@query(f"{_LOG} SELECT seq, sha256(key_str || '-' || seq) AS value FROM w")
def payloads(spark, sf_dir):
    return writes(read_log(spark, sf_dir)).select("seq", workloads.payload(F.col("key_str"), F.col("seq")).alias("value"))


def _lru(entry: str, units: str, capacity: int) -> str:
    """A recency cache by stack distances: an entry is held while it and all entries asked for since fit."""
    return f"""{_LOG}, a AS (SELECT inode % 16 AS shard, seq, inode, {entry} AS e, op <> 'GET' AS wr, {units} AS u FROM log),
v AS (SELECT *, max(u) OVER (PARTITION BY shard, inode, e) AS size, lag(seq) OVER k AS before, lead(seq) OVER k AS after FROM a WINDOW k AS (PARTITION BY shard, inode, e ORDER BY seq)),
since AS (SELECT v.seq, sum(x.size) AS held FROM v JOIN v x ON x.shard = v.shard AND x.seq > v.seq AND (v.after IS NULL OR x.seq < v.after) AND (x.after IS NULL OR x.after > coalesce(v.after, 9e15)) GROUP BY v.seq),
d AS (SELECT v.*, size + coalesce(held, 0) > {capacity} AS lost FROM v LEFT JOIN since USING (seq)),
m AS (SELECT *, before IS NULL OR lag(lost) OVER (PARTITION BY shard, inode, e ORDER BY seq) AS miss FROM d),
stay AS (SELECT *, sum(miss::INT) OVER (PARTITION BY shard, inode, e ORDER BY seq) AS stay FROM m),
ends AS (SELECT shard, inode, e, stay, bool_or(lost) AS gone, bool_or(wr) AS dirty, max(size) AS size FROM stay GROUP BY ALL),
x AS (SELECT shard, count(*) FILTER (gone) AS evictions, count(*) FILTER (gone AND dirty) AS dirty, coalesce(sum(size) FILTER (NOT gone), 0)::BIGINT AS held FROM ends GROUP BY shard)
SELECT shard, count(*) FILTER (NOT miss) AS hits, count(*) FILTER (miss) AS misses, evictions, dirty, held FROM m JOIN x USING (shard) GROUP BY shard, evictions, dirty, held"""


@query(_lru("block", "1", 64))
def lru_cache(spark, sf_dir):
    return caches.simulate_lru(read_log(spark, sf_dir))


@query(_lru("block // 4", "512 * (1 + inode % 5 + block // 4 % 3)", 65536))
def lru_cache_bytes(spark, sf_dir):
    """Pages of four blocks in a cache of 64 KiB."""
    size = 512 * (1 + F.pmod("inode", F.lit(5)) + F.pmod(F.floor(F.col("block") / 4), F.lit(3)))
    return caches.simulate_lru(read_log(spark, sf_dir), capacity=65536, coarse=4, size=size)


@query(f"{_LOG} SELECT inode, block, max(seq) AS last FROM log GROUP BY 1, 2 ORDER BY last LIMIT 10")
def lru_victims(spark, sf_dir):
    return caches.least_recent(read_log(spark, sf_dir))
