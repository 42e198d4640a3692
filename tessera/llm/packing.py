"""Packing documents into fixed windows by the sum-of-squares rule.

Each partition of the scan packs its own documents online. A level array counts the open windows at
every fill level; a document goes where the sum of the squared counts afterwards is least, which
keeps any one level from filling up. Documents of a window or more give full windows first. At the
end, or when a worker holds too many open windows, the pieces of the emptiest windows are placed into
the others by the same rule, and cut where that fills a window. What the last open window holds is cut
at powers of two, which need no padding. A partition therefore leaves no padding, needs no shuffle, and
a lost executor's partition packs again to the same result.

Defined results: null and empty texts are their end id alone; null ids pass through; repeated rows
are packed one by one; very long texts are encoded whole, in a slice of their own; other columns aren't
read; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import arrow_rows, bounded

WINDOW = 4096
#: Open windows that a worker holds (8 KB each, of ids below 2**16); beyond it the emptiest go into the others.
OPEN = 8192
#: Words whose ids a worker remembers from one slice to the next; a slice of more words has them all in its table.
REMEMBERED = 1_000_000
#: Words that are encoded in one call.
BLOCK = 500
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts. Words between ASCII white space are encoded once each: the vocabulary drops white space, so no token crosses it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to deal out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, and how many each has. Words go in blocks, parted by a special token, which no token crosses either."""
        odd = {i: self.tokenizer.encode(w, add_special_tokens=False).ids for i, w in enumerate(words) if "<|" in w} if self.special else {}
        if not self.special:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)
        mark, sign = next(iter(self.special.items()))
        blocks = [sign.join([*(("" if i + k in odd else w) for k, w in enumerate(words[i : i + BLOCK])), ""]) for i in range(0, len(words), BLOCK)]
        flat = np.array([x for e in self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False) for x in e.ids], np.uint32)
        marks = np.flatnonzero(flat == mark)
        n = np.diff(marks, prepend=-1) - 1
        flat = np.delete(flat, marks)
        if odd:
            cut = np.cumsum(n) - n
            pieces, before = [], 0
            for i, ids in odd.items():
                pieces += [flat[before : cut[i]], np.array(ids, np.uint32)]
                before, n[i] = cut[i], len(ids)
            flat = np.concatenate([*pieces, flat[before:]])
        return flat, n

    def learn(self, words: K.Words, keys: np.ndarray, at: np.ndarray) -> None:
        """Adds words that aren't known: keys (sorted), each with the index of one occurrence."""
        raw = words.buf.tobytes()
        ids, n = self.encode_words([raw[a:b].decode() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])
        begin = len(self.ids) + np.cumsum(n) - n
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, begin)
        self.length = np.insert(self.length, place, n)
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def encode(self, part: pa.RecordBatch, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, each followed by end_id, and the n + 1 offsets."""
        words = K.Words(*K.text_of(part.column("text")))
        unique, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)

        def find() -> np.ndarray:
            place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
            return place if len(self.keys) else np.zeros(0, np.int64)

        place = find()
        new = self.keys[place] != unique if len(place) else np.ones(len(unique), bool)
        if new.any():
            if len(self.keys) + new.sum() > REMEMBERED:  # the table is emptied, so what was known is needed again
                self.clear()
                new[:] = True
            self.learn(words, unique[new], at[new])
            place = find()
        if not np.array_equal(self.keys[place], unique):
            raise RuntimeError("words without ids")
        place = place[back] if len(place) else np.zeros(0, np.int64)
        n, begin = self.length[place].astype(np.int64), self.begin[place]
        total = int(n.sum())
        sums = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=sums[1:])
        gather = np.arange(total) + np.repeat(begin - sums[:-1], n)
        flat = self.ids[gather]
        per_doc = sums[words.first]
        offsets = per_doc + np.arange(len(per_doc))
        out = np.full(total + part.num_rows, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = flat
        return out, offsets


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """The online packer of one partition."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open, self.sequence = window, most_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.open: dict[int, list[list]] = {}  # by level: lists of (doc, start, ids, doc_tokens)
        self.n_open = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.emit([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        if start < total:
            small = len(ids) == 0 or int(ids.max()) < 1 << 16
            self.place((doc, start, ids[start:].astype(np.uint16 if small else np.uint32), total))

    def place(self, piece: tuple) -> None:
        size, n, c = len(piece[2]), self.window, self.count
        # moving a window from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h]) + 2;
        # a new window (h = 0) by 2 N[size] + 1; one that becomes full leaves the sum by 2 N[h] - 1
        target = c[size : n + 1].copy()
        change = 2 * target + 2 - 2 * c[: n + 1 - size]
        change[0] = 2 * c[size] + 1
        change[n - size] = 1 - 2 * c[n - size]
        change[1:][c[1 : n + 1 - size] == 0] = np.iinfo(np.int64).max
        h = len(change) - 1 - int(np.argmin(change[::-1]))  # of ties the fullest
        level = h + size
        pieces = [*(self.taken(h) if h else ()), piece]
        if level == n:
            self.emit(pieces)
            return
        self.opened(level, pieces)
        if self.n_open > self.most_open:
            self.empty(self.most_open // 2)

    def empty(self, leave: int) -> None:
        """Leaves at most `leave` windows open: the pieces of the emptiest one go into the others, again and again. What the last one holds is cut at powers of two."""
        while self.n_open > max(leave, 1):
            for piece in self.taken(int(np.flatnonzero(self.count)[0])):
                self.squeeze(piece)
        if leave or not self.n_open:
            return
        level = int(np.flatnonzero(self.count)[0])
        rest = self.taken(level)[::-1]
        while level:
            need, out = 1 << (level.bit_length() - 1), []
            level -= need
            while need:
                doc, start, ids, total = rest.pop()
                out.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    rest.append((doc, start + need, ids[need:], total))
                need -= len(out[-1][2])
            self.emit(out)

    def taken(self, level: int) -> list[tuple]:
        """The pieces of an open window, which is open no more."""
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def squeeze(self, piece: tuple) -> None:
        """Places a piece into open windows only, by the same rule; where it is longer than a window's room, it is cut there."""
        n, c = self.window, self.count
        while True:
            size, levels = len(piece[2]), np.flatnonzero(c)
            if not len(levels):
                self.opened(size, [piece])
                return
            after = np.minimum(levels + size, n)
            change = np.where(after < n, 2 * c[after] + 2 - 2 * c[levels], 1 - 2 * c[levels])
            h = int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])  # of ties the fullest
            doc, start, ids, total = piece
            room = n - h
            pieces = [*self.taken(h), (doc, start, ids[:room], total)]
            if size < room:
                self.opened(h + size, pieces)
                return
            self.emit(pieces)
            if size == room:
                return
            piece = (doc, start + room, ids[room:], total)

    def opened(self, level: int, pieces: list[tuple]) -> None:
        self.open.setdefault(level, []).append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def taken_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document's slice of ids, their CRC-32, and its place in a sequence."""
    bounded(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def rows() -> pa.RecordBatch:
            taken = packer.taken_rows()
            return arrow_rows(names, list(zip(*taken, strict=True)) if taken else [[]] * 7, [pa.int64()] * 7)

        for batch in batches:
            for part in K.slices(batch):
                ids, offsets = encoder(vocabulary).encode(part, end_id)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    packer.add(doc, ids[a:b])
                yield rows()
        packer.empty(0)
        yield rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
