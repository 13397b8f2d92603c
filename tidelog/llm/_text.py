"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of whole Arrow batches: a batch of texts is one byte buffer plus
offsets, a word is a (start, length) span of that buffer, and a word's identity is a 64-bit hash of
its bytes.  Null texts are empty texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_MUL2 = U64(0xBF58476D1CE4E5B9)
_MUL3 = U64(0x94D049BB133111EB)

#: A-Z to a-z, every other byte kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of the form [^\x20\x09-\x0D]+ .
BLANK_WORD = np.ones(256, dtype=bool)
BLANK_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z, non-ASCII).
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """The Arrow mapper run; at a task's end the worker, which Spark keeps, gives free memory back."""

    @functools.wraps(run)
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapper


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * _MUL2
    x = (x ^ (x >> U64(27))) * _MUL3
    return x ^ (x >> U64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, n+1, from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=n + 1, offset=col.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold at most max_bytes together (or one row, if that is longer)."""
    if batch.num_rows == 0:
        return
    _, off = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and the index of each text's first word (n+1 entries).

    Words never cross from one text to the next."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = is_word[buf]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    begins[inner] = w[inner]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    ends[inner - 1] = w[inner - 1]
    starts = np.flatnonzero(begins)
    lens = np.flatnonzero(ends) + 1 - starts
    return starts, lens, np.searchsorted(starts, off)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def _blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, zeros behind the end."""
    padded = np.empty(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    padded[len(buf) :] = 0
    return np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def first_block(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as one number."""
    return _blocks(buf)[starts] & _MASKS[np.minimum(lens, 8)]


def hash_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; equal spans have equal hashes."""
    blocks = _blocks(buf)
    h = (lens.astype(U64) + U64(seed)) * _MUL
    h = mix((h ^ (blocks[starts] & _MASKS[np.minimum(lens, 8)])) * _MUL)
    rest = np.flatnonzero(lens > 8)
    at = 8
    while len(rest):
        more = blocks[starts[rest] + at] & _MASKS[np.minimum(lens[rest] - at, 8)]
        h[rest] = mix((h[rest] ^ more) * _MUL)
        at += 8
        rest = rest[lens[rest] > at]
    return h


def words_of(col: pa.Array, is_word: np.ndarray = BLANK_WORD, lower: bool = True, seed: int = 0):
    """(hashes, first word of each text, buffer, starts, lengths) of a text column."""
    buf, off = text_buffer(col)
    if lower:
        buf = LOWER[buf]
    starts, lens, first = word_spans(buf, off, is_word)
    return hash_spans(buf, starts, lens, seed), first, buf, starts, lens


def hash_ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, at each start (len - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = mix(h[: len(h) - n + 1] + U64(n * int(_MUL) % (1 << 64)))
    for k in range(1, n):
        out = mix((out ^ h[k : len(h) - n + 1 + k]) * _MUL + U64(k))
    return out


def crc32_rows(ids: list) -> np.ndarray:
    """crc32 of each id's decimal text; -1 for null."""
    import zlib

    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) for x in ids], dtype=np.int64)


def spans_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of all elements of the spans, one span after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's slice; empty slices give 0."""
    c = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return c[first[1:]] - c[first[:-1]]


class HashIndex:
    """Position of each of n distinct non-zero hashes, found for whole arrays at once."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(2 * len(hashes) + 1))))
        self.mask = U64(size - 1)
        self.keys, self.at = np.zeros(size, U64), np.zeros(size, np.int32)
        slot, on = hashes & self.mask, np.arange(len(hashes))
        while len(on):
            free = on[self.keys[slot[on]] == 0]
            self.keys[slot[free]] = hashes[free]
            mine = free[self.keys[slot[free]] == hashes[free]]
            self.at[slot[mine]] = mine
            lost = np.ones(len(hashes), bool)
            lost[mine] = False
            on = on[lost[on]]
            slot[on] = (slot[on] + U64(1)) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions; -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        slot, on = h & self.mask, np.arange(len(h))
        while len(on):
            key = self.keys[slot[on]]
            hit = key == h[on]
            out[on[hit]] = self.at[slot[on[hit]]]
            on = on[~hit & (key != 0)]
            slot[on] = (slot[on] + U64(1)) & self.mask
        return out


class Counter:
    """Counts of 64-bit keys within one task, given out whenever many are held."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        return self.put(*np.unique(keys, return_counts=True))

    def put(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for n of each key."""
        self.parts.append((keys, n))
        self.held += len(keys)
        return self.take() if self.held > self.most else None

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.held = ([], 0) if self.held > self.most // 2 else ([(keys, n)], len(keys))
        return (keys, n) if not self.parts else None

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        self.most = 0
        self.held += 1
        return self.take()


class Memo:
    """Entries 0, 1, ... of up to ``most`` distinct spans, known by hash, length and first bytes.

    Once full, it keeps what it has."""

    def __init__(self, most: int):
        self.most, self.known = most, 0
        self.mask = U64((1 << int(np.ceil(np.log2(2 * most)))) - 1)
        self.keys, self.entry = np.zeros(int(self.mask) + 1, U64), np.zeros(int(self.mask) + 1, np.int32)
        self.check = np.zeros(most, U64)

    @staticmethod
    def keys_of(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(hash_spans(buf, starts, lens), U64(1)), first_block(buf, starts, lens) ^ (lens.astype(U64) << U64(40))

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entries of spans; -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        slot, on = h & self.mask, np.arange(len(h))
        while len(on):
            key = self.keys[slot[on]]
            hit = key == h[on]
            out[on[hit]] = self.entry[slot[on[hit]]]
            on = on[~hit & (key != 0)]
            slot[on] = (slot[on] + U64(1)) & self.mask
        found = np.flatnonzero(out >= 0)
        out[found[self.check[out[found]] != check[found]]] = -1
        return out

    def add(self, h: np.ndarray, check: np.ndarray) -> int:
        """Adds the first of these new, distinct spans while there is room; how many were added."""
        k = min(len(h), self.most - self.known)
        e = self.known + np.arange(k)
        self.check[e] = check[:k]
        self.known += k
        slot, on = h[:k] & self.mask, np.arange(k)
        while len(on):
            free = on[self.keys[slot[on]] == 0]
            self.keys[slot[free]] = h[free]
            mine = free[self.keys[slot[free]] == h[free]]
            self.entry[slot[mine]] = e[mine]
            lost = np.ones(k, bool)
            lost[mine] = False
            on = on[lost[on]]
            slot[on] = (slot[on] + U64(1)) & self.mask
        return k


def distinct(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each distinct pair, the pair of each index)."""
    order = np.lexsort((check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back
