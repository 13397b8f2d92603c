"""Key columns: binary keys (kind, big-endian numbers or a name), padded decimal keys, prefixes.

Binary keys sort as unsigned bytes, shorter first among equals, which is Spark's order of BINARY.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(n: Column) -> Column:
    """A long as eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def from_big_endian(b: Column) -> Column:
    """Eight bytes as a long (null for values of 2**63 and more)."""
    return F.conv(F.hex(b), 16, 10).try_cast("long")


def encode_data_key(inode: Column, block: Column) -> Column:
    return F.concat(F.encode(F.lit("d"), "UTF-8"), big_endian(inode), big_endian(block))


def encode_meta_key(inode: Column, name: Column) -> Column:
    return F.concat(F.encode(F.lit("m"), "UTF-8"), big_endian(inode), F.encode(name, "UTF-8"))


def decode_key(key: Column) -> Column:
    """struct(kind, inode, block, name) of a binary key."""
    kind = F.decode(F.substring(key, 1, 1), "UTF-8")
    rest = F.substring(key, 10, 1 << 30)
    return F.struct(
        kind.alias("kind"), from_big_endian(F.substring(key, 2, 8)).alias("inode"),
        F.when(kind == "d", from_big_endian(rest)).alias("block"), F.when(kind == "m", F.decode(rest, "UTF-8")).alias("name"),
    )


def prefix(key: Column) -> Column:
    """Kind and inode, the nine bytes that a cursor stays within."""
    return F.substring(key, 1, 9)


def has_name(key: Column, name: str) -> Column:
    """The key is a meta key of exactly this file name."""
    return (F.substring(key, 1, 1) == F.encode(F.lit("m"), "UTF-8")) & (F.substring(key, 10, 1 << 30) == F.encode(F.lit(name), "UTF-8"))


def padded(n: Column, width: int) -> Column:
    """A decimal number left-padded with zeros, so that text order is number order."""
    return F.lpad(n.cast("string"), width, "0")


def key_text(inode: Column, block: Column) -> Column:
    """The log's text key: ten digits each of inode and block."""
    return F.concat(padded(inode, 10), padded(block, 10))


def successor(key: Column, steps: Column) -> Column:
    """The data key steps blocks behind key."""
    return F.concat(F.substring(key, 1, 9), big_endian(from_big_endian(F.substring(key, 10, 8)) + steps))
