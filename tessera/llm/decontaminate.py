"""Benchmark decontamination by winnowing.

From every window of `window` consecutive item words the k-gram with the least hash is kept (of
ties the last). A document keeps the same k-gram of each of its windows, so every shared window
shares a kept fingerprint. Documents' fingerprints are joined with the items'; at each hit the
windows around it are compared whole (128-bit hashes of all their words), and the windows that match
join to maximal shared spans. Items shorter than a window are matched as one window of their length.

The item index is broadcast only while the benchmark's texts stay under `BLOCK_BYTES`; a larger
benchmark is cut into blocks of items, each with its own pass, whose hits are merged per document.

Defined results: null or wordless texts have no words and no hits; items without words match
nothing; an item with a null id makes hits but isn't named, and items of one id are one; an empty
benchmark hits nothing; an empty table gives no rows; repeated rows are judged one by one; very long
texts are matched whole, in a slice of their own; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import bounded, map_text, number_of, numbered, text_bytes, without, written

WINDOW, GRAM = 13, 7
#: Text bytes of the items in one broadcast index.
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<start:int,end:int>>"


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the least of every `span` consecutive values, of ties the last."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    n = len(grams) - span + 1
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, span):
        less = grams[i : i + n] <= best
        best[less] = grams[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return at


class Index:
    """Fingerprints and whole windows of some benchmark items, by window length."""

    def __init__(self, items: list[tuple], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = [None if i is None else str(i) for i, _ in items]
        data = pa.array([t or "" for _, t in items], pa.large_string())
        words = K.Words(*K.text_of(data), K.NOT_ALNUM)
        a, b = words.hashes(0, lower=True), words.hashes(1, lower=True)
        grams = K.rolling(a, gram)
        found: dict[int, list] = {}
        prints = []
        for k, (start, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            n = min(window, end - start)
            if not n:
                continue
            found.setdefault(n, []).append((K.rolling(a[start:end], n), K.rolling(b[start:end], n, 1), k))
            if n == window:
                own = grams[start : end - gram + 1]
                prints.append(own[np.unique(winnow(own, window - gram + 1))])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.tables = {n: self.table(rows) for n, rows in found.items()}

    @staticmethod
    def table(rows: list) -> tuple:
        first, second = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        item = np.concatenate([np.full(len(r[0]), r[2]) for r in rows])
        order = np.lexsort((item, second, first))
        return first[order], second[order], item[order]

    def matches(self, n: int, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of the windows of n words at the given starts that items hold."""
        first, second, item = self.tables[n]
        lo, hi = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        many = hi - lo
        row = np.repeat(np.arange(len(starts)), many)
        at = np.arange(len(row)) + np.repeat(lo - (np.cumsum(many) - many), many)
        same = second[at] == b[row]
        return starts[row[same]], item[at[same]]

    def scan(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, item) of all windows that items hold."""
        a, room = words.hashes(0, lower=True), words.room()
        b = None
        out = []
        for n in self.tables:
            if n == self.window:
                grams = K.rolling(a, self.gram)
                whole = np.flatnonzero(room[: max(len(grams) - n + self.gram, 0)] >= n)
                kept = np.unique(winnow(grams, n - self.gram + 1)[whole])
                hits = kept[np.isin(grams[kept], self.prints)]
                starts = np.unique((hits[:, None] - np.arange(n - self.gram + 1)).ravel())
                starts = starts[starts >= 0]
                starts = starts[room[starts] >= n]
            else:
                starts = np.flatnonzero(room >= n)
                starts = starts[np.isin(K.rolling(a, n)[starts], self.tables[n][0])]
            if not len(starts):
                continue
            b = words.hashes(1, lower=True) if b is None else b
            at, item = self.matches(n, starts, self.at(a, starts, n, 0), self.at(b, starts, n, 1))
            out.append((at, np.full(len(at), n), item))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @staticmethod
    def at(h: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
        """Window hashes at the given starts only."""
        rows = h[starts[:, None] + np.arange(n)]
        return K.rolling(rows.ravel(), n, seed)[::n]


def blocks_of(items: DataFrame, item_text: str, block_bytes: int) -> int:
    return max(1, -(-text_bytes(items, item_text) // block_bytes))


def indexes(items: DataFrame, n_blocks: int, window: int, gram: int, item_col: str, item_text: str):
    """The broadcast index of each block of items; a block's texts come to the driver alone."""
    items = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))
    for k in range(n_blocks):
        yield items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.where(block == k).collect()], window, gram))


def shared_spans(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: n_words, `spans` (maximal runs of words that items hold) and `items` (ids of the items whose windows occur, sorted as strings)."""
    n_blocks = blocks_of(items, item_text, block_bytes)
    parts = [_pass(docs, index, id_col, text_col) for index in indexes(items, n_blocks, window, gram, item_col, item_text)]
    if n_blocks == 1:
        return parts[0].drop("text_key")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    grouped = merged.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / n_blocks).cast("int").alias("n"),
    )
    joined = F.expr(
        "aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (a, s) -> if(size(a) > 0 and element_at(a, -1).end >= s.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))"
    )
    return grouped.select("doc_id", "n_words", joined.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "n")).alias("n")).drop("n")


def _pass(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        here: Index = index.value
        words = K.Words(*K.text_of(part.column("text")), K.NOT_ALNUM)
        starts, lengths, item = here.scan(words)
        spans: list[list] = [[] for _ in range(part.num_rows)]
        names: list[list] = [[] for _ in range(part.num_rows)]
        if len(starts):
            hit = K.covered(len(words), starts, lengths)
            doc = np.repeat(np.arange(part.num_rows), words.counts())
            new = hit.copy()
            new[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
            last = hit.copy()
            last[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
            for a, b in zip(np.flatnonzero(new).tolist(), np.flatnonzero(last).tolist(), strict=True):
                spans[doc[a]].append({"start": a - int(words.first[doc[a]]), "end": b + 1 - int(words.first[doc[a]])})
            for d, i in np.unique(np.stack([doc[starts], item]), axis=1).T.tolist():
                if here.ids[i] is not None:
                    names[d].append(here.ids[i])
        keys = K.span_hash(words.buf, words.offsets[:-1], words.offsets[1:], 3).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(keys), pa.array(words.counts()), pa.array(spans, pa.list_(span)),
                pa.array([sorted(set(n)) for n in names], pa.list_(pa.string())),
            ],
            names=["doc_id", "text_key", "n_words", "spans", "items"],
        )

    return map_text(docs, id_col, text_col, kernel, f"doc_id long, text_key long, n_words long, spans {SPANS}, items array<string>")


def judged(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """shared_spans with n_hit and the rule: contaminated if any word is hit and hits are a twentieth of the words or more."""
    rows = shared_spans(docs, items, **options)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return rows.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judged(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, item_col: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs, with all their columns, that the rule doesn't call contaminated.

    Every row is judged by itself, so repeated rows, repeated or null ids and columns of any names make no
    difference. Null texts stay; empty tables stay empty. A benchmark of one block is matched in the scan;
    for more blocks rows are written with a number each, by which hits of the blocks come together.
    """
    bounded(docs.sparkSession)
    rows, text = numbered(docs), number_of(docs, text_col)
    names = rows.columns
    if blocks_of(items, item_text, block_bytes) > 1:
        scratch: list[str] = []
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), scratch)
        found = judged(rows, items, id_col="row", text_col=text, window=window, gram=gram, item_col=item_col, item_text=item_text, block_bytes=block_bytes)
        bad = written(found.where("contaminated").select(F.col("doc_id").alias("row")), scratch)
        return without(rows, bad, "row").select(*names).toDF(*docs.columns)
    index = next(indexes(items, 1, window, gram, item_col, item_text))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, text):
                words = K.Words(*K.text_of(part.column(text)), K.NOT_ALNUM)
                starts, lengths, _ = index.value.scan(words)
                n_hit = K.per_doc(K.covered(len(words), starts, lengths), words.first)
                yield part.filter(pa.array((n_hit == 0) | (20 * n_hit < words.counts())))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The same by plain Python, for tests: id to (n_words, hit word indices, item ids)."""
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    known: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if got := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out[d] = (len(w), hit, found)
    return out


def sha(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
