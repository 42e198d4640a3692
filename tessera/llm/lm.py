"""Masked pseudo-likelihood scores of documents.

A small network predicts every token from SIDE tokens on its left and as many on its right. Each
neighbour selects a row of the table of its position: the most frequent words have rows of their own,
others share rows by hash. The sum of the rows goes through tanh. A token is one of CLASSES classes
and one of INSIDE places in it. The class is the leaf of a binary tree whose nodes see that context;
the place is a second one, whose nodes see the context together with the class. Every node starts
from its share of the corpus counts, and shares sum to one, so all words' probabilities do, whatever
the context. A document's score is the sum of log p(token | both sides) over all its tokens.

1. Tokens are lower-cased words. Their counts over the whole corpus come first, exactly (but for equal
   64-bit hashes), as a shuffled table that grows with the vocabulary. The KNOWN most frequent words are
   tokens of their own, dealt over the classes by rank; all other words share the other tokens, and a
   word has its share of its token's count, which is joined from the table.
2. Training covers every document once. In each of ROUNDS rounds all partitions run SGD on their
   share of that round's documents, from the same parameters, and the results are averaged, each row
   by how often it was trained (in the order of partitions, so that sums are the same every time).
3. Scoring maps the finished network over all texts; counts of the rarer words are joined.

Parameters have a fixed size and are broadcast; counts of words are not. All of them but the rows of
neighbours are dense matrices that stay in a core's cache.

Defined results: null, empty and wordless texts have no tokens and the score 0; null ids pass
through; repeated rows get the same score; very long texts are handled whole, in batches; other columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import arrow_rows, bounded, gathered, written

#: Levels of the two trees, tokens that rarer words share, hidden units, and neighbours on a side.
CLASS_BITS, INSIDE_BITS, SHARED, HIDDEN, WIDE, SIDE = 6, 10, 2048, 16, 32, 2
CLASSES, INSIDE = 1 << CLASS_BITS, 1 << INSIDE_BITS
TOKENS = CLASSES * INSIDE
#: Words with a token of their own.
KNOWN = TOKENS - SHARED
#: Rows of a position: of the most frequent words, and of all others by hash.
OWN_ROWS, HASHED_ROWS = 4096, 4096
ROWS = OWN_ROWS + HASHED_ROWS
SLOTS = 1 << 21
ROUNDS, BATCH, RATE = 2, 2048, 0.1
#: Words of which a worker sends counts at once.
COUNTED = 1 << 19
#: Parameters in a row of an exchange, and the fixed point of logarithms that are summed in a shuffle.
CHUNK, FIXED = 1 << 13, float(1 << 32)
#: Bytes of text for each word, about.
WORD_BYTES = 6
#: Least logit of a node's outcome, so that products of a path stay in range.
LEAST_LOGIT = -40


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, K.Words]:
    words = K.Words(*K.text_of(part.column("text")))
    return words.hashes(9, lower=True), words


def rounds_of(batch: pa.RecordBatch) -> np.ndarray:
    """The round that trains each text. A hash needs some 20 times the bytes of its texts, so a batch of any size is hashed in slices."""
    hashes = [np.zeros(0, np.uint64)]
    for part in K.slices(batch):
        buf, offsets = K.text_of(part.column("text"))
        hashes.append(K.span_hash(buf, offsets[:-1], offsets[1:], 4))
    return np.concatenate(hashes) % np.uint64(ROUNDS)


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Occurrences of each word (its hash) in all documents: counts of some slices, then a shuffled sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return arrow_rows(["h", "n"], [h.view(np.int64), n], [pa.int64(), pa.int64()])

        for batch in batches:
            for part in K.slices(batch):
                held.append(words_of(part)[0])
                if sum(map(len, held)) >= COUNTED:
                    yield counted()
        yield counted()

    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, n long")
    return written(partial.groupBy("h").agg(F.sum("n").alias("n")))


def path(leaf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(levels, n): the nodes on the way to each leaf of a binary tree (1 is the root, 2k and 2k + 1 are below k), and 1 where they are left to the right, else -1."""
    level, leaf = np.arange(bits, dtype=np.int32)[:, None], leaf.astype(np.int32)[None]
    sign = ((leaf >> (bits - 1 - level)) & 1).astype(np.float32)
    sign *= 2
    sign -= 1
    return (1 << level) + (leaf >> (bits - level)), sign


def shares(leaves: np.ndarray) -> np.ndarray:
    """For rows of leaf counts, the log odds of right against left at each node."""
    rows, n = leaves.shape
    out = np.zeros((rows, n))
    while n > 1:
        out[:, n // 2 : n] = np.log(leaves[:, 1::2] / leaves[:, ::2])
        leaves = leaves[:, 1::2] + leaves[:, ::2]
        n //= 2
    return out


class Network:
    #: Trained parameters, and those of which a batch touches some rows only.
    DENSE, SPARSE = ("inner", "top", "top_bias", "mix", "by_class", "low"), ("embedding",)

    def __init__(self, top: np.ndarray, top_n: np.ndarray, in_shared: np.ndarray, seed: int = 17):
        """top: hashes of the most frequent words, the most frequent first; in_shared: occurrences of all words by the token they would share."""
        slot = (top >> np.uint64(11)).astype(np.int64) % SLOTS
        first = np.sort(np.unique(slot, return_index=True)[1])  # of words with one slot the most frequent is known
        self.keys, top_n = top[first], top_n[first]
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[slot[first]] = np.arange(len(first))
        rest = in_shared - np.bincount((self.keys % np.uint64(SHARED)).astype(np.int64), weights=top_n, minlength=SHARED).astype(np.int64)
        self.log_rest, self.n_words = np.log(np.maximum(rest, 1)), int(in_shared.sum())
        counts = np.ones(TOKENS)
        counts[: len(top_n)] += top_n
        counts[KNOWN:] += rest
        leaves = counts.reshape(INSIDE, CLASSES).T  # token = place * CLASSES + class
        f = np.float32
        self.inside_bias = shares(leaves).astype(f).ravel()
        self.top_bias = shares(leaves.sum(1)[None])[0][:, None].astype(f)
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (2 * SIDE * ROWS, HIDDEN)).astype(f)
        self.inner = np.zeros(HIDDEN, f)
        self.top = np.zeros((CLASSES, HIDDEN), f)
        self.mix = rng.normal(0, HIDDEN**-0.5, (HIDDEN, WIDE)).astype(f)
        self.by_class = rng.normal(0, 0.1, (CLASSES, WIDE)).astype(f)
        self.low = np.zeros((INSIDE_BITS, WIDE), f)

    def own(self) -> Network:
        """A network with parameters of its own."""
        net = Network.__new__(Network)
        net.__dict__ |= self.__dict__
        for name in self.DENSE + self.SPARSE:
            setattr(net, name, getattr(self, name).copy())
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.DENSE + self.SPARSE])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.DENSE + self.SPARSE:
            p = getattr(self, name)
            setattr(self, name, flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size

    def weights(self, seen: int, visits: dict[str, np.ndarray]) -> np.ndarray:
        """How often each parameter was trained."""
        dense = sum(getattr(self, name).size for name in self.DENSE)
        return np.concatenate([np.full(dense, seen, np.float32), *(np.repeat(visits[name], getattr(self, name).shape[1]) for name in self.SPARSE)])

    def tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, and which of the words are not known."""
        token = self.slots[(hashes >> np.uint64(11)).astype(np.int64) % SLOTS].astype(np.int64)
        other = token < 0
        if len(self.keys):
            other |= self.keys[token] != hashes
        token[other] = KNOWN + (hashes[other] % np.uint64(SHARED)).astype(np.int64)
        return token, other

    def around(self, token: np.ndarray, hashes: np.ndarray, words: K.Words) -> np.ndarray:
        """(positions, n): the rows of each token's neighbours; row 0 stands for the outside of a text too."""
        row = np.where(token < OWN_ROWS, token, OWN_ROWS + (hashes >> np.uint64(52)).astype(np.int64)).astype(np.uint16)
        room = words.room()
        index = np.arange(len(row)) - np.repeat(words.first[:-1], words.counts())
        rows = np.zeros((2 * SIDE, len(row)), np.uint16)
        for k, d in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
            if d < 0:
                rows[k, -d:] = row[:d]
                rows[k, index < -d] = 0
            else:
                rows[k, :-d] = row[d:]
                rows[k, room <= d] = 0
            rows[k] += np.uint16(k * ROWS)
        return rows

    def forward(self, token: np.ndarray, rows: np.ndarray) -> tuple:
        """Logits of the outcomes on each token's way through both trees, (levels, n) each, and what gradients need."""
        h = self.embedding.take(rows[0], axis=0)
        for r in rows[1:]:
            h += self.embedding.take(r, axis=0)
        h += self.inner
        np.tanh(h, out=h)
        cls, n = token & (CLASSES - 1), np.arange(len(token))
        node, way = path(cls, CLASS_BITS)
        z = (self.top @ h.T + self.top_bias)[node, n]
        z *= way
        wide = h @ self.mix
        wide += self.by_class.take(cls, axis=0)
        np.tanh(wide, out=wide)
        place, turn = path(token >> CLASS_BITS, INSIDE_BITS)
        place += cls.astype(np.int32) << INSIDE_BITS
        y = self.low @ wide.T
        y += self.inside_bias.take(place)
        y *= turn
        return z, y, (h, wide, cls, node, way, turn)

    def gradients(self, z: np.ndarray, y: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean of -log p: of the dense parameters, and of the sum of the rows of each token's neighbours."""
        h, wide, cls, node, way, turn = kept
        n, one = np.arange(len(cls)), np.ones(len(cls), np.float32)
        with np.errstate(over="ignore"):  # beyond the range of exp a gradient is 0
            dz, dy = (sign / ((1 + np.exp(x)) * np.float32(-len(n))) for x, sign in ((z, way), (y, turn)))
        at_nodes = np.zeros((CLASSES, len(n)), np.float32)
        at_nodes[node, n] = dz
        at_class = np.zeros((CLASSES, len(n)), np.float32)
        at_class[cls, n] = 1
        slope = wide * wide
        np.subtract(1, slope, out=slope)
        dwide = dy.T @ self.low
        dwide *= slope
        dh = at_nodes.T @ self.top
        dh += dwide @ self.mix.T
        slope = h * h
        np.subtract(1, slope, out=slope)
        dh *= slope
        return {"inner": one @ dh, "top": at_nodes @ h, "top_bias": (at_nodes @ one)[:, None], "mix": h.T @ dwide, "by_class": at_class @ dwide, "low": dy @ wide}, dh

    def train(self, token: np.ndarray, rows: np.ndarray, memory: dict[str, np.ndarray], visits: dict[str, np.ndarray]) -> None:
        """One pass of SGD; steps are scaled by the past gradients of each parameter, of a row those of the whole row."""
        for i in range(0, len(token), BATCH):
            r = rows[:, i : i + BATCH]
            grads, dh = self.gradients(*self.forward(token[i : i + BATCH], r))
            for name, g in grads.items():
                memory[name] += g * g
                getattr(self, name)[...] -= RATE * g / (np.sqrt(memory[name]) + 1e-6)
            for at in r:
                by = np.argsort(at, kind="stable")
                at = at[by]
                begin = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
                g, at, many = np.add.reduceat(dh.take(by, axis=0), begin, axis=0), at[begin], np.diff(begin, append=len(at))
                visits["embedding"][at] += many
                m = memory["embedding"].take(at)
                m += np.einsum("ij,ij->i", g, g) / HIDDEN
                memory["embedding"][at] = m
                g *= (RATE / (np.sqrt(m) + 1e-6))[:, None]
                self.embedding[at] = self.embedding.take(at, axis=0) - g

    def log_likelihood(self, token: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log p of every token given both its sides."""
        out = np.zeros(len(token))
        for i in range(0, len(token), BATCH):
            z, y, _ = self.forward(token[i : i + BATCH], rows[:, i : i + BATCH])
            for x in (z, y):
                odds = np.exp(-np.maximum(x, LEAST_LOGIT))
                odds += 1
                out[i : i + BATCH] -= np.log(np.multiply.reduce(odds, axis=0, dtype=np.float64))
        return out


def initial(counts: DataFrame) -> Network:
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    shared = counts.groupBy(F.col("h").bitwiseAND(SHARED - 1).alias("leaf")).agg(F.sum("n").alias("n")).toArrow()
    in_shared = np.zeros(SHARED, np.int64)
    in_shared[shared["leaf"].to_numpy()] = shared["n"].to_numpy()
    return Network(top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64), in_shared)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Network, DataFrame]:
    """The network, and the table of the counts (h, n) of all words."""
    bounded(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    counts = corpus_counts(docs, text_col)
    net = initial(counts)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for round_ in range(ROUNDS):
        shared = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            own = shared.value.own()
            memory = {name: np.zeros_like(getattr(own, name)) for name in own.DENSE} | {name: np.zeros(len(getattr(own, name)), np.float32) for name in own.SPARSE}
            visits = {name: np.zeros(len(getattr(own, name)), np.float32) for name in own.SPARSE}
            seen = 0
            for batch in batches:
                for part in K.slices(batch.filter(pa.array(rounds_of(batch) == round_))):
                    hashes, words = words_of(part)
                    token, _ = own.tokens(hashes)
                    own.train(token, own.around(token, hashes, words), memory, visits)
                    seen += len(token)
            flat, w = own.flat(), own.weights(seen, visits)
            at = [i for i in range(0, len(flat), CHUNK) if w[i : i + CHUNK].any()]
            part_id = TaskContext.get().partitionId()
            for i in at:
                yield arrow_rows(
                    ["i", "part", "v", "w"], [[i], [part_id], [flat[i : i + CHUNK].tobytes()], [w[i : i + CHUNK].tobytes()]],
                    [pa.int32(), pa.int32(), pa.binary(), pa.binary()],
                )

        def average(chunk: pa.Table) -> pa.Table:
            total = weight = 0.0
            for row in chunk.sort_by("part").select(["v", "w"]).to_pylist():
                w = np.frombuffer(row["w"], np.float32).astype(np.float64)
                total, weight = total + w * np.frombuffer(row["v"], np.float32), weight + w
            mean = np.where(weight > 0, total / np.maximum(weight, 1), np.nan).astype(np.float32)
            return pa.table({"i": pa.array([chunk["i"][0].as_py()], pa.int32()), "v": pa.array([mean.tobytes()], pa.binary())})

        flat = net.flat()
        for row in texts.mapInArrow(run, "i int, part int, v binary, w binary").groupBy("i").applyInArrow(average, "i int, v binary").toArrow().to_pylist():
            mean = np.frombuffer(row["v"], np.float32)
            here = flat[row["i"] : row["i"] + len(mean)]
            here[...] = np.where(np.isnan(mean), here, mean)
        net = net.own()
        net.load(flat)
    return net, counts


def score(docs: DataFrame, net: Network, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed over tokens), and score, its mean per token.

    Rows are told apart by their partition and place, so docs must be what gives the same rows when read again, as tables do.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in K.slices(batch):
                hashes, words = words_of(part)
                token, other = shared.value.tokens(hashes)
                sums = np.zeros(len(token) + 1)
                each = shared.value.log_likelihood(token, shared.value.around(token, hashes, words))
                each[other] -= shared.value.log_rest[token[other] - KNOWN]
                np.cumsum(each, out=sums[1:])
                total = sums[words.first[1:]] - sums[words.first[:-1]]
                # one row for each document, and one for each of its words whose counts are joined
                rows = row + np.arange(part.num_rows)
                own = np.repeat(rows, words.counts())[other]
                word = np.arange(part.num_rows + len(own)) >= part.num_rows
                blank = np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, own])), pa.concat_arrays([part.column("doc_id"), pa.nulls(len(own), pa.int64())]),
                        pa.array(np.concatenate([words.counts(), blank]), mask=word), pa.array(np.concatenate([total, blank]), mask=word),
                        pa.array(np.concatenate([K.mix(rows.astype(np.uint64)), hashes[other]]).view(np.int64)),
                    ],
                    names=["row", "doc_id", "n_tokens", "total", "h"],
                )
                row += part.num_rows

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(run, "row long, doc_id long, n_tokens long, total double, h long")
    # documents' own rows have the hash of their number, to spread them, and no count
    log_n = F.when(F.col("n_tokens").isNull(), F.round(F.log(F.coalesce("n", F.lit(1))) * FIXED).cast("long"))
    whole = scored.join(counts, "h", "left").groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_tokens", "total")), F.sum(log_n).alias("log_n"))
    whole = whole.select("doc_id", "n_tokens", (F.col("total") + F.coalesce(F.col("log_n") / FIXED, F.lit(0.0))).alias("log_likelihood"))
    return whole.withColumn("score", F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1)))


def digest(docs: DataFrame) -> DataFrame:
    net, counts = fit(docs)
    return gathered(score(docs, net, counts), WORD_BYTES * net.n_words)
