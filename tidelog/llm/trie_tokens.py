"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A pre-token is a word [^\\x20\\x09-\\x0D]+ with the word mark in front.  Its tokens are those of the
segmentation with the largest sum of piece scores.  The forward score of a prefix (the best score of
any segmentation that ends there) does not depend on what follows, so distinct pre-tokens are put
into a trie and each node's score and token count is computed once, level by level, from its
ancestors; terminal nodes store the counts of their pre-tokens.

1.  Distinct pre-tokens of the corpus are counted and range-sorted, so that those of one prefix lie
    together; a trie holds AT_ONCE neighbours.
2.  The pieces come from a public sentencepiece vocabulary (its path is a parameter; no tokenizer is
    trained).  That file ranks its pieces but has no probabilities.  They are counted: from scores
    -log(rank + SHIFT), ``rounds`` times, every pre-token is segmented and its pieces are counted, from
    the deepest nodes of the trie to its root; a piece then scores log((count + 0.5) / (all + ...)).
3.  Tokens and scores of all distinct pre-tokens are one table.  The most frequent ones (about HEAD,
    broadcast) are known on the spot when texts are read; the others of a text are joined with it by 64
    hash bits.

A character that no piece covers becomes its UTF-8 bytes, each with the score of a 256th of all bytes
counted.  Ties keep the shorter last piece.  Pre-tokens of any length go through the trie.

Null and empty texts have no pre-tokens and no tokens; texts of any length are counted whole.  Rows are
counted one by one, whatever their ids.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text as T
from tidelog.llm._scratch import frequent, written

MARK, SHIFT, AT_ONCE, HEAD = "▁", 2.7, 1 << 16, 1 << 18


class Vocabulary:
    """Pieces with their scores, and a hash index of pieces for whole arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        ids.sort(key=lambda k: (-sp.get_score(k), k))
        self.pieces = [sp.id_to_piece(k) for k in ids]
        self.values = -np.log(np.arange(len(ids)) + SHIFT)
        self.byte = -float(np.log(len(ids) + SHIFT))
        self.longest = max(map(len, self.pieces), default=1)
        h = np.zeros(len(ids), T.U64)
        for k, p in enumerate(self.pieces):
            x = np.zeros(1, T.U64)
            for c in reversed(p):  # from the last character, as the trie meets them
                x = self.longer(x, np.array([ord(c)], T.U64))
            h[k] = x[0]
        self.index = T.HashIndex(h)

    @staticmethod
    def longer(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        return T.mix(h * T.U64(0x100000001B3) ^ (char + T.U64(1))) | T.U64(1)

    def counted(self, counts: np.ndarray, n_bytes: float) -> Vocabulary:
        """The same pieces, with scores from how often each was used, and how many bytes."""
        out = copy.copy(self)
        total = counts.sum() + n_bytes + 0.5 * (len(counts) + 256)
        out.values = np.log((counts + 0.5) / total)
        out.byte = float(np.log((n_bytes / 256 + 0.5) / total))
        return out


class Trie:
    """Distinct pre-tokens with the best segmentation of every prefix.  Level by level from the root:
    parent, character, best score, tokens, last piece (-1: bytes) and the node before that."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        v = self.vocabulary = vocabulary
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        begin = np.cumsum(size) - size
        self.bytes_of = lambda c: 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        zero = np.zeros(1, np.int64)
        self.levels = [(zero, zero, np.zeros(1), zero, zero, zero)]
        self.depth, self.node = size, np.zeros(len(words), np.int64)  # each word's terminal
        on, node, depth = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), np.int64), 0
        while len(on):
            key, node = np.unique((node << 21) | codes[begin[on] + depth], return_inverse=True)
            depth += 1
            up, char = key >> 21, key & 0x1FFFFF
            self.levels.append((up, char))
            _, _, best, count, *_ = self.levels[depth - 1]
            wide = self.bytes_of(char)
            s, n = best[up] + wide * v.byte, count[up] + wide
            piece, back = np.full(len(key), -1), up.copy()
            h, at = np.zeros(len(key), T.U64), np.arange(len(key))
            for k in range(1, min(depth, v.longest) + 1):
                level = self.levels[depth - k]
                h = v.longer(h, self.levels[depth - k + 1][1][at].astype(T.U64))
                at = self.levels[depth - k + 1][0][at]
                found = v.index.find(h)
                p = v.values[found] + level[2][at]
                better = (found >= 0) & ((p > s) | (k == 1))
                s, n = np.where(better, p, s), np.where(better, level[3][at] + 1, n)
                piece, back = np.where(better, found, piece), np.where(better, at | (k << 40), back)
            back = np.where(piece < 0, up | (1 << 40), back)
            self.levels[depth] = (up, char, s, n, piece, back)
            ends = size[on] == depth
            self.node[on[ends]] = node[ends]
            on, node = on[~ends], node[~ends]

    def terminals(self) -> tuple[np.ndarray, np.ndarray]:
        """Score and tokens of each word."""
        score, tokens = np.zeros(len(self.node)), np.zeros(len(self.node), np.int64)
        for depth, (_, _, best, count, *_) in enumerate(self.levels):
            own = self.depth == depth
            score[own], tokens[own] = best[self.node[own]], count[self.node[own]]
        return score, tokens

    def used(self, n: np.ndarray) -> tuple[np.ndarray, float]:
        """How often each piece is used, and how many bytes, by n of each word."""
        counts, n_bytes = np.zeros(len(self.vocabulary.pieces)), 0.0
        weight = [np.zeros(len(level[0])) for level in self.levels]
        for depth in range(len(weight)):
            own = self.depth == depth
            np.add.at(weight[depth], self.node[own], n[own])
        for depth in range(len(weight) - 1, 0, -1):
            _, char, _, _, piece, back = self.levels[depth]
            w = weight[depth]
            some = piece >= 0
            counts += np.bincount(piece[some], w[some], len(counts))
            n_bytes += float((w * self.bytes_of(char))[~some].sum())
            step, to = back >> 40, back & ((1 << 40) - 1)
            for k in np.unique(step).tolist():
                own = step == k
                np.add.at(weight[depth - k], to[own], w[own])
        return counts, n_bytes


def _spans(col: pa.Array):
    """(buffer, starts, lengths, first word of each text, hash of each word)."""
    buf, off = T.text_buffer(col)
    starts, lens, first = T.word_spans(buf, off, T.BLANK_WORD)
    return buf, starts, lens, first, np.maximum(T.hash_spans(buf, starts, lens), T.U64(1))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of the distinct words of some texts."""
    for whole in batches:
        for b in T.slices(whole, "text", 8 << 20):
            buf, starts, lens, _, h = _spans(b.column("text"))
            pick, back = T.distinct(h, T.first_block(buf, starts, lens) ^ (lens.astype(T.U64) << T.U64(40)))
            size = lens[pick]
            cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            word = pa.Array.from_buffers(pa.string(), len(pick), [None, pa.py_buffer(cut), pa.py_buffer(buf[T.spans_index(starts[pick], size)])])
            yield pa.RecordBatch.from_pydict({"word": word, "n": pa.array(np.bincount(back, minlength=len(pick)))})


def _tries(vocabulary, give):
    """Mapper of sorted words to give(trie, rows) for each AT_ONCE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def solved():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return give(Trie(vocabulary.value, [MARK + w for w in rows.column("word").to_pylist()]), rows)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= AT_ONCE:
                yield solved()
                held, size = [], 0
        if held:
            yield solved()

    return T.lean(run)


def _used(trie: Trie, rows: pa.RecordBatch) -> pa.RecordBatch:
    counts, n_bytes = trie.used(rows.column("n").to_numpy().astype(float))
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_pydict({"piece": pa.array(np.append(at, -1)), "n": pa.array(np.append(counts[at], n_bytes))})


def _terminals(trie: Trie, rows: pa.RecordBatch) -> pa.RecordBatch:
    score, tokens = trie.terminals()
    buf, off = T.text_buffer(rows.column("word"))
    h = np.maximum(T.hash_spans(buf, off[:-1], np.diff(off)), T.U64(1))
    return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": rows.column("n"), "tokens": pa.array(tokens.astype(np.int32)), "score": pa.array(score)})


def _local(known):
    """Mapper of texts to what is known of them by the frequent words, and their other words (tail)."""
    tail = pa.struct([("h", pa.int64()), ("k", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        index, tokens, score = known.value
        for whole in batches:
            for b in T.slices(whole, "text", 2 << 20):
                _, _, _, first, h = _spans(b.column("text"))
                entry = index.find(h)
                has = entry >= 0
                text = np.repeat(np.arange(b.num_rows), np.diff(first))
                rest = np.flatnonzero(~has)
                pick, back = T.distinct(text[rest].astype(T.U64), h[rest])  # sorted by text
                k, one = np.bincount(back, minlength=len(pick)), rest[pick]
                cut = np.searchsorted(text[one], np.arange(b.num_rows + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(h[one].view(np.int64)), pa.array(k.astype(np.int32))], fields=list(tail))
                entry = np.maximum(entry, 0)
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(rid + np.arange(b.num_rows)), "doc_id": b.column("doc_id"), "n_pretokens": pa.array(np.diff(first)),
                    "n_tokens": pa.array(T.per_text(np.where(has, tokens[entry], 0), first)), "score": pa.array(T.per_text(np.where(has, score[entry], 0.0), first)),
                    "tail": pa.ListArray.from_arrays(pa.array(cut), rows),
                })
                rid += b.num_rows

    return T.lean(run)


def distinct_words(rows: DataFrame) -> DataFrame:
    """(word, n) of all words of rows(text), sorted in ranges."""
    counted = rows.select("text").mapInArrow(T.lean(_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(counted.repartitionByRange(n, "word").sortWithinPartitions("word"), "words")


def estimated(words: DataFrame, vocabulary: Vocabulary, rounds: int = 2) -> Vocabulary:
    """The vocabulary with scores counted over all words, from its own scores on."""
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(vocabulary)
        used = words.select("word", "n").mapInArrow(_tries(sent, _used), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row a piece
        counts, piece = np.zeros(len(vocabulary.pieces) + 1), used["piece"].to_numpy()
        counts[piece] = used["n"].to_numpy()  # bytes come last
        vocabulary = vocabulary.counted(counts[:-1], float(counts[-1]))
    return vocabulary


def count_tokens(docs: DataFrame, model_file: str | None = None, doc_id: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and the summed score of the best segmentations, for every row."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = distinct_words(rows)
    vocabulary = estimated(words, Vocabulary(model_file), rounds)
    table = written(words.mapInArrow(_tries(context.broadcast(vocabulary), _terminals), "h long, n long, tokens int, score double"), "table")

    on_top = frequent(table, HEAD, "h")
    head = table.filter(on_top).toArrow()
    index = T.HashIndex(head["h"].to_numpy().view(T.U64))
    known = context.broadcast((index, np.append(head["tokens"].to_numpy().astype(np.int64), 0), np.append(head["score"].to_numpy(), 0.0)))

    schema = f"rid long, doc_id {kind}, n_pretokens long, n_tokens long, score double, tail array<struct<h: long, k: int>>"
    local = written(rows.mapInArrow(_local(known), schema), "local")
    beyond = local.select("rid", F.explode("tail").alias("w")).select("rid", "w.*").join(table.filter(~on_top).select("h", "tokens", "score"), "h")
    more = beyond.groupBy("rid").agg(F.sum(F.col("k") * F.col("tokens")).alias("more"), F.sum(F.col("k") * F.col("score")).alias("more_score"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    return local.drop("tail").join(more, "rid", "left").select("doc_id", "n_pretokens", (F.col("n_tokens") + zero("more", "long")).alias("n_tokens"), (F.col("score") + zero("more_score", "double")).alias("score"))
