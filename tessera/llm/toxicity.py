"""A convolutional text classifier in numpy.

A word's embedding is the sum of those of three hash buckets: the word's, and those of its first four
and six bytes, so that unseen inflections of a known stem are recognised. Filters of several widths slide
over the words; each filter's largest response in a text (max pooling) feeds a logistic output. For scoring,
a filter's product with each bucket's embedding is tabulated once, so a response is a sum of table rows, and
texts are scored whole, in Arrow batches, without a shuffle.

Every labelled row is learned from. The weights' starting point is found on the driver, on some of the rows
(SAMPLE and SAMPLE_WORDS, by class: whole texts, in the order of a hash of their ids). Then, in each of ROUNDS
rounds, all rows are dealt by a hash of their ids to slices of about SLICE_TEXT bytes; each slice trains a copy
of the model on all of its whole texts, and the copies are averaged on the executors, embeddings by the
number of texts that hold their bucket, so that a word of few slices isn't diluted by the others.

A fifth of the labelled rows, by a hash of their ids, is kept from the weights to calibrate, and all of it does:
the output is shifted so that its best F1 lies at THRESHOLD, and every language gets a threshold of its own
(a column beside the score: the language never enters the score). The rows are counted by outputs to 1 / GRID.
If either part lacks a class, all rows do both.

Defined results: null and empty texts get the score of padding alone; without labels of both
classes every score is the share of toxic labels (0 if there are none); null ids pass through and
belong to no training row; repeated rows are scored one by one, repeated labels count as their maximum,
and of rows with one id one is learned from; very long texts are scored whole, in a slice of their own;
other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import arrow_rows, bounded, discard, map_text, parts_for, written

#: Labelled rows that the starting point is found on, at most: toxic ones, others.
SAMPLE = (2_000, 4_000)
#: Words of their texts at most (12 bytes each on the driver): of toxic ones, of others.
SAMPLE_WORDS = (1_500_000, 3_000_000)
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
#: Bytes of the prefixes that are features beside the whole word.
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.02, 1e-4
#: Words of a batch at most, unless a single text has more.
BATCH_WORDS = 1 << 18
#: Rounds over all labelled rows after the start, and the bytes of text of a slice.
ROUNDS, SLICE_TEXT = 3, 16 << 20
#: A slice of fewer batches than STEPS goes over its rows again in a round, PASSES times at most.
STEPS, PASSES = 32, 3
#: Weights in a piece of a model, and copies that are averaged at once.
PIECE, FAN = 1 << 14, 64
#: One of so many labelled rows calibrates.
BACK = 5
#: Steps to one of the output for calibration, and the farthest step.
GRID, FARTHEST = 1024, 1 << 17
THRESHOLD = 0.7
PAD = max(WIDTHS) - 1


def buckets_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each word of all texts (words x 3), each text followed by PAD empty words (bucket 0), and the n + 1 offsets."""
    words = K.Words(*K.text_of(part.column("text")), K.NOT_ALNUM)
    n, low = words.counts(), K.LOWER[words.buf]
    first = words.first + PAD * np.arange(part.num_rows + 1)
    out = np.zeros((first[-1], 1 + len(PREFIXES)), np.int32)
    at = np.arange(len(words)) + PAD * np.repeat(np.arange(part.num_rows), n)
    for k, most in enumerate((None, *PREFIXES)):
        ends = words.ends if most is None else np.minimum(words.ends, words.starts + most)
        out[at, k] = (K.span_hash(low, words.starts, ends, 5 + k) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return out, first


def rows_at(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the table's rows for each word's buckets."""
    out = table[at[..., 0]]
    for k in range(1, at.shape[-1]):
        out += table[at[..., k]]
    return out


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale = 1.0
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}
        self.tables = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def tabulate(self) -> list[list[np.ndarray]]:
        return [[self.embed @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, words: np.ndarray, first: np.ndarray, tables, places: bool = False):
        """Largest response of each filter in each text, and where it is."""
        tops, where = [], []
        room = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
        for w, rows in zip(WIDTHS, tables, strict=True):
            response = rows_at(rows[0], words)
            for j in range(1, w):
                response[: len(words) - j] += rows_at(rows[j], words[j:])
            response[room < w] = -np.inf
            tops.append(np.maximum.reduceat(response, first[:-1], axis=0))
            if places:
                where.append(np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]))
        return np.concatenate(tops, axis=1), where

    def logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = self.tabulate()
        top, _ = self.pooled(words, first, self.tables)
        return np.maximum(top + self.bias, 0) @ self.out + self.shift[0]

    def score(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.scores_of(self.logits(words, first).astype(np.float64))

    def gradients(self, words: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        top, where = self.pooled(words, first, self.tabulate(), places=True)
        active = np.maximum(top + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.shift[0], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        d_top = np.outer(d, self.out) * (active > 0)
        rows, steps, d_filters = [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = d_top[:, k * FILTERS : (k + 1) * FILTERS]
            df = np.zeros_like(f)
            for j in range(w):
                at = words[np.minimum(where[k] + j, len(words) - 1)]  # texts x filters x buckets; an empty text has no window of the widest, and no gradient
                df[j] = np.einsum("nfd,nf->df", rows_at(self.embed, at), g)
                step = (g[:, :, None] * f[j].T[None]).reshape(-1, DIM)
                for c in range(at.shape[-1]):
                    rows.append(at[..., c].ravel())
                    steps.append(step)
            d_filters.append(df)
        place = (np.concatenate(rows).astype(np.int64)[:, None] * DIM + np.arange(DIM)).ravel()
        d_embed = np.bincount(place, weights=np.concatenate(steps).ravel(), minlength=BUCKETS * DIM).reshape(BUCKETS, DIM).astype(np.float32)
        return [d_embed, *d_filters, d_top.sum(0), active.T @ d, d.sum(keepdims=True)]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 3) -> None:
        """Training from the first weights; buckets that only one text holds stay empty."""
        held = holders(texts)
        self.embed[held < 2] = 0
        self.passes(texts, y, held, [RATE * (1 - epoch / EPOCHS) for epoch in range(EPOCHS)], seed)

    def passes(self, texts: list[np.ndarray], y: np.ndarray, held: np.ndarray, rates: list[float], seed: int) -> None:
        """Adam over shuffled batches, a pass for each rate; buckets that only one text holds aren't learned."""
        rng = np.random.default_rng(seed)
        known = (held >= 2).astype(np.float32)[:, None]
        known[0] = 0
        size = np.array([len(t) for t in texts], np.int64)
        params = self.parameters()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for rate in rates:
            for rows in batches_of(rng.permutation(len(texts)), size):
                first = np.concatenate([[0], np.cumsum([len(texts[r]) for r in rows])])
                words = np.concatenate([texts[r] for r in rows])
                words[rng.random(len(words)) < 0.1] = 0
                grads = self.gradients(words, first, y[rows])
                grads[0] *= known
                step += 1
                for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7) + DECAY * p)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def weights(self, n: int, held: np.ndarray) -> np.ndarray:
        """How much each number of flat() counts in an average: an embedding by the texts that it was learned from, all others by all texts."""
        own = np.repeat(np.where(held >= 2, held, 0), DIM)
        return np.concatenate([own, np.full(sum(p.size for p in self.parameters()) - len(own), n)]).astype(np.float32)

    def calibrate(self, z: np.ndarray, n: np.ndarray, hits: np.ndarray) -> None:
        """Shifts the output so that its best F1 is at 0 (that is THRESHOLD); of n rows with output z / GRID, hits are toxic."""
        self.shift -= np.float32(best_cut(z, n, hits) / GRID)
        spread = float(np.sqrt(np.average((z - np.average(z, weights=n)) ** 2, weights=n))) / GRID
        self.scale = 2.0 / spread if spread > 0 else 1.0

    def scores_of(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def holders(texts: list[np.ndarray]) -> np.ndarray:
    """How many texts hold each bucket."""
    held = np.zeros(BUCKETS, np.int64)
    for t in texts:
        held[np.unique(t)] += 1
    return held


def batches_of(order: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of `order` of at most BATCH texts and BATCH_WORDS words, one text at least; every text is in one."""
    ends, at = np.concatenate([[0], np.cumsum(size[order])]), 0
    while at < len(order):
        to = max(at + 1, min(at + BATCH, int(np.searchsorted(ends, ends[at] + BATCH_WORDS, "right")) - 1))
        yield order[at:to]
        at = to


def best_cut(z: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The cut with the best F1, of n rows at each step z of which hits are toxic; between the steps beside it, and in the middle of equally good ones."""
    order = np.argsort(-z, kind="stable")
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + hits.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[len(best) // 2])
    sorted_z = z[order]
    return float(sorted_z[k] + (sorted_z[k + 1] if k + 1 < len(z) else sorted_z[k] - 1)) / 2


def remainder(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3


def labelled(docs: DataFrame, labels: DataFrame) -> list:
    """(doc_id, toxic, lang, word buckets) of the rows for the starting point, a bounded number: rows whose remainder isn't 1, in the order of a hash."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picked = [r for y, n in zip((1, 0), SAMPLE, strict=True) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame([(r[0], r[1], k) for k, r in enumerate(picked)], "doc_id long, y int, place int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(ids), "doc_id")  # SAMPLE rows at most

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        words, first = buckets_of(part)
        lists = pa.ListArray.from_arrays(pa.array(first * words.shape[1], pa.int32()), pa.array(words.ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in ALSO), lists], names=["doc_id", *ALSO, "words"])

    # a table first: texts may be of any length, so their sizes are looked at before any comes to the driver
    scratch: list[str] = []
    sample = written(map_text(texts, "doc_id", "text", kernel, "doc_id long, y int, lang string, place int, words array<int>", ALSO), scratch)
    one = sample.withColumn("n", F.size("words")).groupBy("place").agg(
        F.min(F.struct("n", F.xxhash64("words").alias("h"))).alias("t"), F.first("y").alias("y"),
    ).select("place", "y", "t.*")
    wanted, total = [], [0, 0]
    for r in one.orderBy("place").collect():  # SAMPLE rows at most
        if total[r.y] + r.n <= SAMPLE_WORDS[1 - r.y] * (1 + len(PREFIXES)):
            total[r.y] += r.n
            wanted.append((r.place, r.h))
    chosen = docs.sparkSession.createDataFrame(wanted, "place int, h long")
    found = sample.withColumn("h", F.xxhash64("words")).join(F.broadcast(chosen), ["place", "h"]).dropDuplicates(["place"]).orderBy("doc_id").toArrow()
    discard(docs.sparkSession, scratch)
    words = (np.asarray(x.values).reshape(-1, 1 + len(PREFIXES)) for x in found["words"])
    return list(zip(found["doc_id"].to_pylist(), found["y"].to_pylist(), found["lang"].to_pylist(), words, strict=True))


#: Columns of the sample that go through the kernel.
ALSO = ("y", "lang", "place")


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, text, lang, n, back) of every labelled row whose remainder isn't 1, one of each id: n bytes of text; back if it calibrates."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("y"),
    ).where(F.col("y").isin(0, 1))
    texts = docs.where(F.col("doc_id").isNotNull() & (remainder() != 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n")
    one = texts.join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct(size, F.xxhash64("text").alias("h"), "text", "lang")).alias("t"), F.first("y").alias("y"))
    return one.select("doc_id", "y", "t.text", "t.lang", "t.n", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BACK)) == 0).alias("back"))


def learned(model: Model, rows: DataFrame, n_bytes: int, rate: float) -> Model:
    """The average of copies of the model that each learned from all rows of one slice."""
    bounded(rows.sparkSession)
    n_slices = parts_for(rows.sparkSession, n_bytes, SLICE_TEXT)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, texts = [], [], []
        for batch in batches:
            for part in K.slices(batch):
                words, first = buckets_of(part)
                ids.append(part.column("doc_id").to_numpy())
                y.append(part.column("y").to_numpy())
                texts += np.split(words, first[1:-1])
        if not texts:
            return
        order, own, held = np.argsort(np.concatenate(ids)), copy.deepcopy(shared.value), holders(texts)
        at = TaskContext.get().partitionId()
        texts = [texts[k] for k in order]
        steps = sum(1 for _ in batches_of(np.arange(len(texts)), np.array([len(t) for t in texts])))
        own.passes(texts, np.concatenate(y)[order].astype(np.float32), held, [rate] * min(PASSES, -(-STEPS // steps)), at)
        flat, w = own.flat(), own.weights(len(texts), held)
        for i in range(0, len(flat), PIECE):
            yield arrow_rows(
                ["i", "part", "v", "w"], [[i], [at], [flat[i : i + PIECE].tobytes()], [w[i : i + PIECE].tobytes()]],
                [pa.int32(), pa.int32(), pa.binary(), pa.binary()],
            )

    def average(pieces: pa.Table) -> pa.Table:
        total = weight = 0.0
        for row in pieces.sort_by("part").select(["v", "w"]).to_pylist():
            w = np.frombuffer(row["w"], np.float32).astype(np.float64)
            total, weight = total + w * np.frombuffer(row["v"], np.float32), weight + w
        mean = (total / np.maximum(weight, 1)).astype(np.float32)
        return pa.table({
            "i": pa.array([pieces["i"][0].as_py()], pa.int32()), "part": pa.array([pieces["part"][0].as_py() // FAN], pa.int32()),
            "v": pa.array([mean.tobytes()], pa.binary()), "w": pa.array([weight.astype(np.float32).tobytes()], pa.binary()),
        })

    dealt = rows.select("doc_id", "y", "text").repartitionById(n_slices, F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(n_slices)).cast("int"))
    pieces, left = dealt.mapInArrow(run, "i int, part int, v binary, w binary"), n_slices
    while True:
        pieces = pieces.groupBy("i", F.floor(F.col("part") / FAN).cast("int")).applyInArrow(average, "i int, part int, v binary, w binary")
        left = -(-left // FAN)
        if left == 1:
            break
    flat = model.flat()
    for row in pieces.toArrow().to_pylist():  # one model
        v, w = np.frombuffer(row["v"], np.float32), np.frombuffer(row["w"], np.float32)
        here = flat[row["i"] : row["i"] + len(v)]
        here[...] = np.where(w > 0, v, here)
    out = copy.deepcopy(model)
    out.load(flat)
    return out


def outputs(model: Model, rows: DataFrame) -> DataFrame:
    """(lang, z, n, hits): how many rows of a language have the output z / GRID, and how many of them are toxic."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        z = np.clip(np.rint(shared.value.logits(*buckets_of(part)) * GRID), -FARTHEST, FARTHEST).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column("lang"), pa.array(z), part.column("y")], names=["lang", "z", "y"])

    return map_text(rows, "doc_id", "text", kernel, "lang string, z int, y int", ("lang", "y")).groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with its shift, scale and thresholds by language set by all rows."""
    scratch: list[str] = []
    counts = written(outputs(model, rows), scratch)
    found = counts.groupBy("z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()  # 2 * FARTHEST + 1 rows at most
    out = copy.deepcopy(model)
    out.calibrate(*(found[c].to_numpy().astype(np.int64) for c in ("z", "n", "hits")))
    moved, scores = float(out.shift[0]) - float(model.shift[0]), out.scores_of

    def threshold(own: pa.Table) -> pa.Table:
        z, n, hits = (own[c].to_numpy().astype(np.int64) for c in ("z", "n", "hits"))
        cut = [scores(best_cut(z, n, hits) / GRID + moved)] if min(hits.sum(), (n - hits).sum()) >= 5 else []
        return pa.table({"lang": own["lang"].slice(0, len(cut)), "cut": pa.array(cut, pa.float64())})

    cuts = counts.where(F.col("lang").isNotNull()).groupBy("lang").applyInArrow(threshold, "lang string, cut double")
    out.thresholds = {r.lang: r.cut for r in cuts.collect()}
    discard(rows.sparkSession, scratch)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    scratch: list[str] = []
    rows = written(learnable(docs, labels), scratch)
    sizes = {(r.y, r.back): r for r in rows.groupBy("y", "back").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    toxic, other = (sum(r.rows for (y, _), r in sizes.items() if y == own) for own in (1, 0))
    model = Model()
    if not toxic or not other:
        model.constant = float(toxic > 0)
    else:
        apart = len(sizes) == 4  # both classes in both parts
        fitting, calibrating = (rows.where(~F.col("back")), rows.where("back")) if apart else (rows, rows)
        n_bytes = sum(r.n for (_, back), r in sizes.items() if not (apart and back))
        start = labelled(fitting, rows.withColumnRenamed("y", "toxic"))
        start = [start[i] for i in np.random.default_rng(5).permutation(len(start))]
        model.fit([r[3] for r in start], np.array([r[1] for r in start], np.float32))
        for k in range(ROUNDS):
            model = learned(model, fitting, n_bytes, RATE * (1 - k / ROUNDS))
        model = calibrated(model, calibrating)
        model.tables = model.tabulate()
        model.embed = np.zeros((1, DIM), np.float32)  # the tables have it
    discard(docs.sparkSession, scratch)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the verdict under the threshold of the document's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        m: Model = shared.value
        s = m.score(*buckets_of(part))
        cuts = [m.thresholds.get(x, THRESHOLD) for x in part.column("lang").to_pylist()]
        return arrow_rows(
            ["doc_id", "score", "predicted", "predicted_by_lang"],
            [part.column("doc_id"), s, (s >= THRESHOLD).astype(np.int32), (s >= np.array(cuts)).astype(np.int32)],
            [pa.int64(), pa.float64(), pa.int32(), pa.int32()],
        )

    rows = map_text(docs, "doc_id", "text", kernel, "doc_id long, score double, predicted int, predicted_by_lang int", ("lang",))
    return rows.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "predicted_by_lang")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
