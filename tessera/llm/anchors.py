"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of `block` words, which are the index; every
rolling window of as many words probes it. With block = (window + 1) // 2, a repeated window of
`window` words holds a whole block of either copy, so that block is hit by a probe at the other.
Hits are extended to the windows around them, which are compared whole (96 bits of all their words,
across the corpus); windows that occur again join to maximal exact repeats.

Both questions, "which blocks occur again" and "which windows occur again", are asked through
`exchange`: no pairs are made, however often a passage occurs.

Defined results: null and wordless texts have no words and lose none; null ids pass through;
repeated rows are copies of one another and lose what a window covers; very long texts are a group of
their own, handled whole; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernels as K
from tessera.llm.exchange import Exchange, Question, distinct, divided, read, together
from tessera.llm.frames import gathered

WINDOW = 35


class Group:
    """The words, blocks and windows of one group of documents."""

    def __init__(self, docs: pa.Table, window: int):
        self.docs, self.window, self.block = docs, window, (window + 1) // 2
        self.words = K.Words(*K.text_of(docs.column("text")))
        self.h = self.words.hashes(0)
        self.room = self.words.room()
        self.begin = np.repeat(self.words.first[:-1], self.words.counts())  # of each word's document

    def probes(self):
        """Rolling windows of a block's length: sorted distinct keys, rank of each start, the starts, and which starts are blocks."""
        starts = np.flatnonzero(self.room >= self.block)
        keys = K.rolling(self.h, self.block)[starts] if len(starts) else np.zeros(0, np.uint64)
        first, rank = distinct(keys)
        within = starts - self.begin[starts]
        return keys[first], rank, starts, within % self.block == 0

    def candidates(self, hit: np.ndarray, rank: np.ndarray, starts: np.ndarray, is_block: np.ndarray) -> np.ndarray:
        """Starts of the windows whose own block is hit."""
        hits = starts[is_block & hit[rank]]
        first = np.maximum(hits - self.block + 1, self.begin[hits])
        near = K.covered(len(self.words), first, hits + 1 - first)
        return np.flatnonzero(near & (self.room >= self.window))

    def windows(self, at: np.ndarray):
        a = K.rolling(self.h, self.window)[at] if len(at) else np.zeros(0, np.uint64)
        b = (K.rolling(self.words.hashes(1), self.window, 1)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        return a, b, *distinct(a, b)


def probes(window: int, bits: int) -> Question:
    """Which of a group's rolling windows of a block's length occur again and are a block somewhere."""
    shift = 64 - bits

    def ask(docs: pa.Table, _):
        g = Group(docs, window)
        keys, rank, _, is_block = g.probes()
        many = np.bincount(rank, minlength=len(keys)) > 1
        block = np.zeros(len(keys), bool)
        block[rank[is_block]] = True
        return keys, [keys >> np.uint64(shift), (many + 2 * block).astype(np.uint8)], None

    def answer(groups: list) -> list[list[np.ndarray]]:
        """Hit: some document has the block, and it occurs more than once."""
        keys, flags = together(groups)
        first, rank = distinct(keys)
        n = np.bincount(rank, weights=1.0 + (flags & 1), minlength=len(first))
        block = np.bincount(rank, weights=flags >> 1, minlength=len(first))
        return divided([((n > 1) & (block > 0))[rank].astype(np.uint8)], groups)

    return Question(ask, [np.uint64, np.uint8], answer, [np.uint8], shift)


def repeats(window: int) -> Question:
    """Which of the windows around hit blocks occur again."""

    def ask(docs: pa.Table, replies: dict):
        g = Group(docs, window)
        keys, rank, starts, is_block = g.probes()
        (hit,) = read(replies.get(0, []), [np.uint8], len(keys))
        at = g.candidates(hit > 0, rank, starts, is_block)
        a, b, first, rank = g.windows(at)
        many = np.bincount(rank, minlength=len(first)) > 1
        return a[first], [a[first], b[first], many.astype(np.uint8)], None

    def answer(groups: list) -> list[list[np.ndarray]]:
        a, b, many = together(groups)
        first, rank = distinct(a, b)
        n = np.bincount(rank, weights=1.0 + many, minlength=len(first))
        return divided([(n > 1)[rank].astype(np.uint8)], groups)

    return Question(ask, [np.uint64, np.uint32, np.uint8], answer, [np.uint8])


def removed_words(docs: pa.Table, replies: dict, window: int) -> tuple[K.Words, np.ndarray]:
    g = Group(docs, window)
    keys, rank, starts, is_block = g.probes()
    (hit,) = read(replies.get(0, []), [np.uint8], len(keys))
    at = g.candidates(hit > 0, rank, starts, is_block)
    *_, first, rank = g.windows(at)
    (again,) = read(replies.get(1, []), [np.uint8], len(first))
    return g.words, K.covered(len(g.words), at[again[rank] > 0], window)


def remove_repeats(docs: DataFrame, result, schema: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", small: bool = False, **sizes) -> DataFrame:
    """result(docs, words, removed) for each group of documents: `removed` flags the words that a repeated window covers. sizes: of groups, parts and blocks."""
    ex = Exchange(docs, id_col, text_col, **sizes)
    ex.ask(0, probes(window, ex.bits))
    ex.ask(1, repeats(window))
    out = ex.finish(lambda docs, replies: result(docs, *removed_words(docs, replies, window)), schema)
    return gathered(out, ex.n_bytes) if small else out


def kept_words(docs: pa.Table, words: K.Words, removed: np.ndarray) -> list[bytes]:
    """Each document's other words, joined by one space."""
    lost = K.per_doc(removed, words.first).tolist()
    out = []
    for text, a, b, n in zip(docs.column("text").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), lost, strict=True):
        own = (text or "").encode().split()
        out.append(b" ".join(compress(own, (~removed[a:b]).tolist()) if n else own))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text that is left."""
    return remove_repeats(
        docs,
        lambda d, w, r: pa.table([d.column("doc_id"), pa.array([k.decode() for k in kept_words(d, w, r)], pa.string())], names=["doc_id", "text"]),
        "doc_id long, text string", window, id_col, text_col,
    )


def digest(docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    def result(table: pa.Table, words: K.Words, removed: np.ndarray) -> pa.Table:
        shas = [hashlib.sha256(k).hexdigest() for k in kept_words(table, words, removed)]
        return pa.table(
            [
                table.column("doc_id"), pa.array(words.counts(), pa.int64()),
                pa.array(K.per_doc(removed, words.first), pa.int64()), pa.array(shas, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return remove_repeats(docs, result, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, small=True, **sizes)
