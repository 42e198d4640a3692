"""Corpus-wide questions about fingerprints, in bulk.

Substring dedup has to know, for every one of very many rolling fingerprints, what the rest of the
corpus holds. One shuffled row for each would be many times the text. Here documents are dealt into
groups of a few MB. A group asks with its distinct fingerprints only, sorted and cut by fingerprint
range into one compressed block per part; a part merges the blocks of all groups and answers each
with arrays in the order of its questions. A key that a third of all documents hold is one
fingerprint per group, so no part grows with it. Documents stay where they are dealt (all rounds
reuse the same exchange); a lost executor's groups and parts are recomputed from their blocks.

Groups times parts grows with the square of the corpus. Where that would make blocks smaller than
`BLOCK_BYTES` of text, questions go by way of relays: a group sends one block for each coarse range,
a relay merges the blocks of many groups for one coarse range, asks its parts like a group, and hands
the answers back in the order of its blocks. Blocks stay large, and their number in proportion to the
corpus, at the price of sending each question twice.

A group is read once for each round, and its rows arrive in the order in which shuffled blocks come
in. So it is put in order first: the same documents ask the same questions every time.

Defined results: null ids and texts are rows like others; repeated rows stay, dealt by the partitions
that they come from; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import bounded, parts_for, text_bytes

#: Bytes of text in a group, of text for each part and each relay, and the least of a block.
GROUP_BYTES, PART_BYTES, RELAY_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20, 16 << 20, 1 << 10
#: Groups of small tables, and parts: two for each partition of a shuffle, between these bounds.
LEAST, MOST_LEAST = 24, 128


def pack(columns: list[np.ndarray], blob: np.ndarray | None = None) -> bytes:
    """Arrays of one length, by planes of bytes, and more bytes after them; compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    head = np.uint64(len(columns[0])).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes, *([] if blob is None else [blob.tobytes()])]))


def unpack(block: bytes, kinds: list) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n, out, at = int(raw[:8].view(np.uint64)[0]), [], 8
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = raw[at : at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out, raw[at:]


def deltas(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def cut(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The n_parts + 1 bounds of the parts, equal ranges of 64 bits, in sorted keys."""
    bounds = [-(-(k << 64) // n_parts) for k in range(1, n_parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]])


def in_order(docs: pa.Table) -> pa.Table:
    """The rows by id and text, whatever order they came in; rows that tie are the same."""
    ids = docs.column("doc_id").combine_chunks()
    buf, offsets = K.text_of(docs.column("text"))
    keys = K.span_hash(buf, offsets[:-1], offsets[1:], 6)
    order = np.lexsort((keys, np.asarray(ids.fill_null(0) if ids.null_count else ids), np.asarray(ids.is_null())))
    return docs.take(pa.array(order))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Question:
    """What groups ask in a round, and how a part answers.

    ask(docs, earlier replies) gives sorted 64-bit keys, columns, of which the first is keys >> shift, and
    further bytes or None. answer gets a list of (columns, bytes) and gives a list of columns for each.
    """

    ask: Callable
    kinds: list
    answer: Callable
    replies: list
    shift: int = 0
    #: From columns: bytes that belong to each row, and values of the answer to it (without: none, one).
    blob_sizes: Callable | None = None
    reply_sizes: Callable | None = None

    def blocks(self, columns: list[np.ndarray], blob: np.ndarray | None, keys: np.ndarray, n_parts: int) -> tuple[list[int], list[bytes]]:
        """The parts that a block goes to, and the blocks."""
        at = cut(keys, n_parts)
        full = np.flatnonzero(np.diff(at)).tolist()
        ends = None if self.blob_sizes is None else np.concatenate([[0], np.cumsum(self.blob_sizes(columns), dtype=np.int64)])
        data = []
        for p in full:
            a, b = at[p], at[p + 1]
            data.append(pack([deltas(columns[0][a:b]), *(c[a:b] for c in columns[1:])], None if ends is None else blob[ends[a] : ends[b]]))
        return full, data

    def unpacked(self, block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        columns, blob = unpack(block, self.kinds)
        columns[0] = np.cumsum(columns[0], dtype=self.kinds[0])
        return columns, blob

    def merged(self, blocks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray | None, np.ndarray, np.ndarray, list[int]]:
        """The rows of some blocks in the order of keys: columns, bytes, each row's index before, answers to each, and rows of each block."""
        got = [self.unpacked(b) for b in blocks]
        columns = [np.concatenate(c) for c in zip(*(g[0] for g in got), strict=True)]
        order = np.argsort(columns[0], kind="stable")
        blob = None
        if self.blob_sizes is not None:
            sizes = np.asarray(self.blob_sizes(columns), np.int64)
            blob = np.concatenate([g[1] for g in got])[spans((np.cumsum(sizes) - sizes)[order], sizes[order])]
        columns = [c[order] for c in columns]
        n_replies = np.ones(len(order), np.int64) if self.reply_sizes is None else np.asarray(self.reply_sizes(columns), np.int64)
        return columns, blob, order, n_replies, [len(g[0][0]) for g in got]


class Exchange:
    """Documents dealt into groups, and rounds of questions over them."""

    def __init__(
        self, docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES,
        block_bytes: int = BLOCK_BYTES, relay_bytes: int = RELAY_BYTES,
    ):
        bounded(docs.sparkSession)
        self.n_bytes = n_bytes = text_bytes(docs, text_col)
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        self.n_groups = parts_for(docs.sparkSession, n_bytes, group_bytes, LEAST)
        self.n_parts = parts_for(docs.sparkSession, n_bytes, part_bytes, max(LEAST, min(2 * n, MOST_LEAST)))
        #: Coarse ranges, and relays of each; none while blocks are large enough.
        self.n_coarse = self.n_relays = 0
        if parts_for(docs.sparkSession, n_bytes, group_bytes) * parts_for(docs.sparkSession, n_bytes, part_bytes) * block_bytes > max(n_bytes, block_bytes):
            self.n_coarse = isqrt(self.n_parts - 1) + 1
            self.n_relays = parts_for(docs.sparkSession, n_bytes, relay_bytes * self.n_coarse)
        #: Leading bits of a fingerprint that a question needs where a false match only costs work: 34 within a part.
        self.bits = min(64, 34 + (self.n_parts - 1).bit_length())
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # repeated rows, such as ones of nulls, are spread by where they come from
        group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(self.n_groups))
        self.docs = rows.withColumn("g", group).repartition(min(n, self.n_groups), "g")
        self.replies: DataFrame | None = None

    def ask(self, stage: int, q: Question) -> None:
        """A round of questions; the answers are there for the next round and at the end."""
        names, n_first = ["p", "g", "block"], self.n_coarse or self.n_parts

        def asked_by(docs: pa.Table, replies: dict) -> pa.Table:
            g = docs.column("g")[0].as_py() if docs.num_rows else 0
            keys, columns, blob = q.ask(in_order(docs), replies)
            parts, data = q.blocks(columns, blob, keys, n_first)
            return pa.table([pa.array(parts, pa.int32()), pa.array([g] * len(parts), pa.int64()), pa.array(data, pa.binary())], names=names)

        def answered(table: pa.Table) -> pa.Table:
            out = [pack(columns) for columns in q.answer([q.unpacked(b) for b in table.column("block").to_pylist()])]
            n = table.num_rows
            return pa.table([table.column("g"), pa.array([stage] * n, pa.int32()), table.column("p"), pa.array(out, pa.binary())], names=["g", "stage", "p", "block"])

        schema, replies = "p int, g long, block binary", "g long, stage int, p int, block binary"
        if self.replies is None:
            asked = self.docs.groupBy("g").applyInArrow(lambda docs: asked_by(docs, {}), schema)
        else:
            asked = self.docs.groupBy("g").cogroup(self.replies.groupBy("g")).applyInArrow(lambda docs, replies: asked_by(docs, by_stage(replies)), schema)
        if not self.n_coarse:
            new = asked.groupBy("p").applyInArrow(answered, replies)
        else:
            new = self.relayed(asked, stage, q, answered, schema, replies)
        self.replies = new if self.replies is None else self.replies.unionByName(new)

    def relayed(self, asked: DataFrame, stage: int, q: Question, answered: Callable, schema: str, replies: str) -> DataFrame:
        """The answers to coarse blocks, asked by relays."""
        n_parts = self.n_parts
        relay = F.col("p").cast("long") * self.n_relays + F.pmod(F.xxhash64("g"), F.lit(self.n_relays))
        coarse = asked.withColumn("r", relay)

        def sorted_blocks(table: pa.Table) -> tuple[list, list, list]:
            rows = sorted(zip(table.column("g").to_pylist(), table.column("p").to_pylist(), table.column("block").to_pylist(), strict=True), key=lambda r: r[:2])
            return tuple(map(list, zip(*rows, strict=True)))

        def passed_on(table: pa.Table) -> pa.Table:
            _, _, blocks = sorted_blocks(table)
            columns, blob, *_ = q.merged(blocks)
            parts, data = q.blocks(columns, blob, columns[0].astype(np.uint64) << np.uint64(q.shift), n_parts)
            r = table.column("r")[0].as_py()
            return pa.table([pa.array(parts, pa.int32()), pa.array([r] * len(parts), pa.int64()), pa.array(data, pa.binary())], names=["p", "g", "block"])

        def handed_back(table: pa.Table, answers: pa.Table) -> pa.Table:
            g, p, blocks = sorted_blocks(table)
            _, _, order, sizes, rows = q.merged(blocks)
            values = read(by_stage(answers).get(stage, []), q.replies, int(sizes.sum()))
            back = np.argsort(order)
            values = [v[spans((np.cumsum(sizes) - sizes)[back], sizes[back])] for v in values]
            ends = np.cumsum(sizes[back])[np.cumsum(rows) - 1][:-1]
            data = [pack(list(v)) for v in zip(*(np.split(v, ends) for v in values), strict=True)]
            n = len(g)
            return pa.table(
                [pa.array(g, pa.int64()), pa.array([stage] * n, pa.int32()), pa.array(p, pa.int32()), pa.array(data, pa.binary())],
                names=["g", "stage", "p", "block"],
            )

        fine = coarse.groupBy("r").applyInArrow(passed_on, schema).groupBy("p").applyInArrow(answered, replies)
        return coarse.groupBy("r").cogroup(fine.withColumnRenamed("g", "r").groupBy("r")).applyInArrow(handed_back, replies)

    def finish(self, result: Callable, schema: str) -> DataFrame:
        """result(docs, replies) for each group."""
        return self.docs.groupBy("g").cogroup(self.replies.groupBy("g")).applyInArrow(lambda docs, replies: result(in_order(docs), by_stage(replies)), schema)


def by_stage(replies: pa.Table) -> dict[int, list[bytes]]:
    """The answers to a group, by stage, in the order of parts: that of its sorted questions."""
    rows = sorted(zip(replies.column("stage").to_pylist(), replies.column("p").to_pylist(), replies.column("block").to_pylist(), strict=True), key=lambda r: r[:2])
    out: dict[int, list[bytes]] = {}
    for stage, _, block in rows:
        out.setdefault(stage, []).append(block)
    return out


def read(blocks: list[bytes], kinds: list, n: int) -> list[np.ndarray]:
    """The answers of a stage, n values each, as whole columns."""
    out = [np.concatenate(c) for c in zip(*(unpack(b, kinds)[0] for b in blocks), strict=True)] if blocks else [np.zeros(0, k) for k in kinds]
    if len(out[0]) != n:
        raise RuntimeError(f"{len(out[0])} answers to {n} questions")
    return out


def divided(columns: list[np.ndarray], groups: list) -> list[list[np.ndarray]]:
    """Columns over the rows of all groups, one after the other, cut by group."""
    ends = np.cumsum([len(g[0][0]) for g in groups])[:-1]
    return [list(c) for c in zip(*(np.split(c, ends) for c in columns), strict=True)]


def together(groups: list) -> list[np.ndarray]:
    """The columns of all groups as one."""
    return [np.concatenate(c) for c in zip(*(g[0] for g in groups), strict=True)]


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of keys (the first is the main one): the index of the first row of each distinct one, and each row's rank."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank
