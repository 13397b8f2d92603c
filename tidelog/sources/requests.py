"""Decoders of request vectors and protocol lines, and trace files.

Binary request vectors are decoded in Arrow batches (their layout is sequential); everything that is
text stays in SQL functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import FILE_OPS, OPCODES

_NAMES = {v: k for k, v in OPCODES.items()}
_FIELDS = {"GET": ("length",), "SET": ("offset", "length"), "RANGEDEL": ("offset",), "RANGEGET": ("offset", "length"), "RMW": ("offset", "length")}
DECODED = "tid long, pos int, op string, key binary, offset int, length int, value binary"


def decode_vector(buffer: bytes) -> list[tuple]:
    """(tid, pos, op, key, offset, length, value) of one vector: u32 tid, u16 count, then requests of
    u8 type and, but for commits, u16 key length, key and the type's fields; values follow SET and RMW."""
    tid, count = struct.unpack_from("<IH", buffer, 0)
    at, out = 6, []
    for pos in range(count):
        op = _NAMES[buffer[at]]
        at += 1
        key, fields, value = None, {}, None
        if op not in ("COMMIT", "BEGIN", "ABORT"):
            (n,) = struct.unpack_from("<H", buffer, at)
            key, at = buffer[at + 2 : at + 2 + n], at + 2 + n
            for f in _FIELDS.get(op, ()):
                (fields[f],) = struct.unpack_from("<H", buffer, at)
                at += 2
            if op in ("SET", "RMW"):
                value, at = buffer[at : at + fields["length"]], at + fields["length"]
        out.append((tid, pos, op, key, fields.get("offset"), fields.get("length"), value))
    return out


def encode_vector(tid: int, requests: list[tuple]) -> bytes:
    """The inverse of decode_vector, from (op, key, offset, length, value)."""
    out = struct.pack("<IH", tid, len(requests))
    for op, key, offset, length, value in requests:
        out += bytes([OPCODES[op]])
        if key is not None:
            out += struct.pack("<H", len(key)) + key
            for f in _FIELDS.get(op, ()):
                out += struct.pack("<H", {"offset": offset, "length": length}[f] or 0)
            out += value or b""
    return out


def decode_vectors(buffers: DataFrame, column: str = "buffer") -> DataFrame:
    """One row per request of every vector of a binary column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for buf in b[column] if buf is not None for r in decode_vector(bytes(buf))]
            out = pd.DataFrame(rows, columns=["tid", "pos", "op", "key", "offset", "length", "value"])
            yield out.astype({"offset": "Int32", "length": "Int32"})

    return buffers.select(column).mapInPandas(run, DECODED)


def encode_vectors(log: DataFrame, column: str = "buffer") -> DataFrame:
    """One binary vector for each transaction of a log (tid, seq, op, key_str, offset, payload), requests by
    seq; a transaction's requests must fit into memory, as its vector does."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        rows = [(op, k.encode(), o, len(p), p) for op, k, o, p in zip(pdf["op"], pdf["key_str"], pdf["offset"], (p.encode() for p in pdf["payload"]), strict=True)]
        rows = [(op, k, o, n, p if op in ("SET", "RMW") else None) for op, k, o, n, p in rows]
        return pd.DataFrame({column: [encode_vector(int(key[0]), rows)]})

    return log.select("tid", "seq", "op", "key_str", "offset", "payload").groupBy("tid").applyInPandas(run, f"{column} binary")


def explode_requests(vectors: DataFrame) -> DataFrame:
    """Rows of an array-of-struct vector table, with their position as seq."""
    return vectors.select("tid", F.posexplode("requests").alias("seq", "r")).select("tid", "seq", "r.op", "r.key", "r.offset", "r.length", "r.value")


#: The request header of the public network block device protocol (all numbers big-endian).
NBD_MAGIC = "25609513"
NBD_TYPES = {0: "READ", 1: "WRITE", 2: "DISCONNECT", 3: "FLUSH", 4: "TRIM"}


def encode_block_commands(rows: DataFrame) -> DataFrame:
    """Frames of a network block device from rows (cookie, op, offset, length, payload)."""
    kind = F.create_map(*(F.lit(x) for k, v in NBD_TYPES.items() for x in (v, k)))[F.col("op")]
    number = lambda c, width: F.unhex(F.lpad(F.hex(c), width, "0"))
    head = F.concat(F.unhex(F.lit(NBD_MAGIC)), number(F.lit(0), 4), number(kind, 4), number(F.col("cookie"), 16), number(F.col("offset"), 16), number(F.col("length"), 8))
    return rows.select(F.concat(head, F.when(F.col("op") == "WRITE", F.coalesce(F.encode("payload", "UTF-8"), F.encode(F.lit(""), "UTF-8"))).otherwise(F.encode(F.lit(""), "UTF-8"))).alias("frame"))


def decode_block_commands(frames: DataFrame, column: str = "frame", page_bytes: int = 4096) -> DataFrame:
    """(cookie, op, offset, length, first_page, pages, payload) of frames of a network block device; frames
    of another magic or type raise an error.  Flushes and disconnects touch no pages."""
    part = lambda at, n: F.conv(F.hex(F.substring(F.col(column), at, n)), 16, 10).cast("long")
    name = F.create_map(*(F.lit(x) for k, v in NBD_TYPES.items() for x in (k, v)))[part(7, 2).cast("int")]
    known = F.hex(F.substring(F.col(column), 1, 4)) == NBD_MAGIC
    rows = frames.select(
        part(9, 8).alias("cookie"), F.coalesce(F.when(known, name), F.raise_error(F.lit("not a block command")).cast("string")).alias("op"),
        part(17, 8).alias("offset"), part(25, 4).alias("length"), F.substring(F.col(column), 29, 1 << 30).alias("payload"),
    )
    first, data = F.floor(F.col("offset") / page_bytes), F.col("op").isin("READ", "WRITE", "TRIM") & (F.col("length") > 0)
    pages = F.when(data, F.floor((F.col("offset") + F.col("length") - 1) / page_bytes) - first + 1).otherwise(F.lit(0))
    return rows.select("cookie", "op", "offset", "length", first.alias("first_page"), pages.alias("pages"), "payload")


def translate(rows: DataFrame, column: str = "file_op") -> DataFrame:
    """Rows with the store's op and opcode of a file-system request; unknown requests raise an error."""
    lookup = lambda table, c: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]
    op = F.coalesce(lookup(FILE_OPS, F.col(column)), F.raise_error(F.concat(F.lit("no such request: "), F.col(column))).cast("string"))
    return rows.withColumn("op", op).withColumn("opcode", lookup(OPCODES, F.col("op")))


def trace_lines(log: DataFrame) -> DataFrame:
    """Trace text: `tid type keylen kind inode block offset length crc`, one line per request."""
    code = F.create_map(*(F.lit(x) for pair in OPCODES.items() for x in pair))[F.col("op")]
    length = F.length("payload")
    return log.select("seq", F.concat_ws(" ", "tid", code, F.lit(17), F.lit("d"), "inode", "block", F.lit(0), length, F.crc32(F.col("payload").cast("binary"))).alias("line"))


def parse_trace(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trace rows in the schema schema.TRACE; commits have two fields, meta keys a name instead of a block."""
    f = F.split(F.trim(column), r"\s+")
    get = lambda k, kind: F.get(f, F.lit(k)).try_cast(kind)
    meta = F.get(f, F.lit(3)) == "m"
    return lines.filter(F.trim(column) != "").select(
        get(0, "long").alias("tid"), get(1, "int").alias("type"), get(2, "int").alias("keylen"), get(3, "string").alias("kind"), get(4, "long").alias("inode"),
        F.when(~meta, get(5, "long")).alias("block"), F.when(meta, get(5, "string")).alias("name"), get(6, "int").alias("offset"), get(7, "int").alias("length"), get(8, "long").alias("crc"),
    )


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_trace(spark.read.text(path))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under a directory tree."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def expand_mget(trace: DataFrame) -> DataFrame:
    """MGET lines as one GET per key: the line's offset column counts the keys."""
    mget = F.col("type") == OPCODES["MGET"]
    step = F.explode(F.when(mget & (F.col("offset") > 0), F.sequence(F.lit(0), F.col("offset") - 1)).otherwise(F.array(F.lit(0))))
    return trace.withColumn("step", step).select(
        "tid", F.when(mget, OPCODES["GET"]).otherwise(F.col("type")).alias("type"), "keylen", "kind", "inode", (F.col("block") + F.col("step")).alias("block"), "name",
        F.when(mget, 0).otherwise(F.col("offset")).alias("offset"), "length", "crc",
    )


def parse_resp(lines: DataFrame, column: str = "value") -> DataFrame:
    """SET and GET commands of RESP frames, one whole frame a row."""
    part = lambda k: F.regexp_extract(column, r"^\*[23]\r?\n\$\d+\r?\n(\w+)\r?\n\$\d+\r?\n([^\r\n]*)(?:\r?\n\$\d+\r?\n([^\r\n]*))?", k)
    op = F.upper(part(1))
    return lines.filter(op.isin("SET", "GET")).select(op.alias("op"), part(2).alias("key"), F.when(op == "SET", part(3)).alias("value"))


def parse_network_trace(lines: DataFrame, column: str = "value") -> DataFrame:
    """`type keylen seq scanlength key valuelen` lines (1 write, 2 read, 3 range)."""
    f = F.split(F.trim(column), r"\s+")
    kind = F.create_map(F.lit("1"), F.lit("SET"), F.lit("2"), F.lit("GET"), F.lit("3"), F.lit("RANGEGET"))[f[0]]
    return lines.filter(F.size(f) >= 6).select(kind.alias("op"), f[1].cast("int").alias("keylen"), f[2].cast("long").alias("seq"), f[3].cast("int").alias("scanlength"), f[4].alias("key"), f[5].cast("long").alias("valuelen"))


def network_trace_lines(rows: DataFrame) -> DataFrame:
    code = F.create_map(F.lit("SET"), F.lit("1"), F.lit("GET"), F.lit("2"), F.lit("RANGEGET"), F.lit("3"))[F.col("op")]
    return rows.select(F.concat_ws(" ", code, "keylen", "seq", "scanlength", "key", "valuelen").alias("value"))


#: Parsers of text protocols, by name.
PROTOCOLS = {"trace": parse_trace, "resp": parse_resp, "network": parse_network_trace}


def parse(lines: DataFrame, protocol: str, column: str = "value") -> DataFrame:
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol}; one of {sorted(PROTOCOLS)}")
    return PROTOCOLS[protocol](lines, column)
