"""Vectorised numpy kernels over Arrow text batches: words, word hashes, window hashes, covers.

Everything works on one slice of documents at a time (`slices`), whose size in bytes is bounded
apart from single documents, so a worker's memory does not follow the size of a partition.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 19
U64 = np.uint64
_STEPS = (U64(30), U64(0xBF58476D1CE4E5B9), U64(27), U64(0x94D049BB133111EB), U64(31))


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: \x20 and \x09-\x0D: what parts words in most operators.
SPACES = byte_class(b" \t\n\x0b\x0c\r")
#: All ASCII but digits and letters: what parts words for the benchmark matcher.
NOT_ALNUM = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values with good avalanche (the splitmix64 finaliser)."""
    a, m, b, n, c = _STEPS
    x = x ^ (x >> a)
    x *= m
    x ^= x >> b
    x *= n
    x ^= x >> c
    return x


@functools.cache
def _seeded(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(7_919 + seed)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    base = int(rng.integers(1, 2**61)) * 8 + 3
    return table, base, pow(base, -1, 2**64)


@functools.lru_cache(maxsize=64)
def _steps(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1 ... n - 1 modulo 2**64, as the products of two short tables: large ones aren't kept."""
    low, rows = _steps(base, 4096), max(1, -(-n // 4096))
    high = _steps(pow(base, 4096, 2**64), 1 << (rows - 1).bit_length())[:rows]
    return np.multiply.outer(high, low).ravel()[:n]


def text_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs, n = column.buffers(), len(column)
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(bufs[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Row ranges of a batch with at most `limit` bytes of text each, one row at least."""
    _, offsets = text_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some documents: byte spans, and where each document's words begin."""

    __slots__ = ("buf", "ends", "first", "offsets", "starts")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        self.buf, self.offsets = buf, offsets
        inside = ~separators[buf]
        before = np.empty_like(inside)
        if len(buf):
            before[0], before[1:] = False, inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(buf)]
            before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        if len(buf):
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            edges = offsets[1:] - 1
            after[edges[edges >= 0]] = False
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.ends = self.starts
        #: Index of each document's first word, and the number of words at the end.
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        n = self.counts()
        return np.repeat(self.first[1:], n) - np.arange(len(self.starts))

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        return span_hash(LOWER[self.buf] if lower else self.buf, self.starts, self.ends, seed)


def prefix_sums(buf: np.ndarray, seed: int) -> np.ndarray:
    table, base, _ = _seeded(seed)
    sums = np.zeros(len(buf) + 1, U64)
    if len(buf):
        v = table[buf]
        v *= powers(base, len(buf))
        np.cumsum(v, out=sums[1:])
    return sums


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial modulo 2**64 over random byte values, then mixed with the length."""
    _, _, inverse = _seeded(seed)
    sums = prefix_sums(buf, seed)
    back = powers(inverse, len(buf) + 1)
    h = (sums[ends] - sums[starts]) * back[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def rolling(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive values of h (len(h) - n + 1 of them), by doubling."""
    if len(h) < n:
        return np.zeros(0, U64)
    base = _seeded(1_000 + seed)[1]
    have, at, out, done = h, 1, None, 0
    left = n
    while left:
        if left & 1:
            if out is None:
                out, done = have, at
            else:  # the run of `done` values is followed by one of `at`
                m = len(h) - done - at + 1
                out = out[:m] * U64(pow(base, at, 2**64)) + have[done : done + m]
                done += at
        left >>= 1
        if left:
            m = len(h) - 2 * at + 1
            have = have[:m] * U64(pow(base, at, 2**64)) + have[at : at + m]
            at *= 2
    return mix(out[: len(h) - n + 1] + U64(n))


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in [start, start + length) for some start."""
    starts = np.asarray(starts)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of them have an equal key at a smaller index."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return more, later


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of set flags of each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
