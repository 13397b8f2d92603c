"""Explicit schemas and the fixed geometry of the store's model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Geometry:
    """Sizes that results depend on."""

    page_bytes: int = 8192
    piece_bytes: int = 512
    data_value_bytes: int = 4096
    meta_value_bytes: int = 512
    pages_per_block: int = 256
    blocks_per_segment: int = 64
    segment_rows: int = 510
    segment_key_bytes: int = 7040
    prefix_bytes: int = 9
    scan_row_cap: int = 5090
    scan_value_bytes: int = 152
    meta_per_page: int = 16
    data_per_page: int = 2
    command_bytes: int = 16384


GEOMETRY = Geometry()

#: Transaction states, in the order of their numbers.
TXN_STATES = ("EMPTY", "CACHED", "LOGGED", "COMMIT", "CACHEDCOMMIT", "COMPACTION", "NONFULLCOMPACTION", "WAITFLUSHCOMMITCACHED", "WAITFLUSHCOMMITLOGGED", "WAITCOMMIT")
#: States whose rows a cursor sees.
VISIBLE_STATES = ("CACHED", "LOGGED", "COMMIT", "CACHEDCOMMIT")

LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()), T.StructField("tid", T.LongType()), T.StructField("op", T.StringType()),
        T.StructField("inode", T.LongType()), T.StructField("block", T.LongType()), T.StructField("key_str", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("payload", T.StringType()), T.StructField("committed", T.BooleanType()),
    ]
)
REQUEST = T.StructType(
    [
        T.StructField("seq", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()),
        T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("value", T.BinaryType()),
    ]
)
VECTORED = T.StructType([T.StructField("tid", T.LongType()), T.StructField("requests", T.ArrayType(REQUEST))])
TRACE = T.StructType(
    [
        T.StructField("tid", T.LongType()), T.StructField("type", T.IntegerType()), T.StructField("keylen", T.IntegerType()), T.StructField("kind", T.StringType()),
        T.StructField("inode", T.LongType()), T.StructField("block", T.LongType()), T.StructField("name", T.StringType()), T.StructField("offset", T.IntegerType()),
        T.StructField("length", T.IntegerType()), T.StructField("crc", T.LongType()),
    ]
)

#: Request types and their numbers.
OPCODES = {
    "SET": 1, "GET": 2, "DELETE": 3, "AGAIN": 4, "NOTFOUND": 5, "CACHE_HIT": 6, "RMW": 7, "BEGIN": 8, "COMMIT": 9, "ITER_CREATE": 10, "ITER_NEXT": 11, "ITER_NEXT_VALUE": 12,
    "ITER_ALL": 13, "ITER_ALL_VALUE": 14, "ITER_RELEASE": 15, "RANGEGET": 16, "KEYRANGE": 17, "ABORT": 19, "RANGEDEL": 20, "MGET_NOTFOUND": 21, "MGET": 22, "DEFRAG": 23,
}
#: What requests of a file system become.
FILE_OPS = {
    "META_GET": "GET", "DATA_GET": "GET", "DATA_SEQ_SET": "SET", "META_SET": "SET", "META_SYNC_SET": "SET", "DATA_SET": "SET", "META_DEL": "DELETE", "DATA_DEL": "DELETE",
    "DATA_DEL_MULTI": "RANGEDEL", "META_CURSOR": "RANGEGET", "DATA_CURSOR": "RANGEGET", "META_UPDATE": "RMW", "DATA_UPDATE": "RMW", "COMMIT": "COMMIT", "GET_MULTI": "MGET",
}
