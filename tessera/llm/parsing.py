"""Byte-level substring dedup on a prefix-free parse.

A rolling hash of GRAM bytes makes triggers, which cut a text into overlapping phrases. A trigger is
the place whose hash is least (of ties the last) in some window of `window` bytes, rather than a
fixed residue, so that every window holds the trigger that it belongs to: equal windows have equal
triggers at equal places, inside any phrase. A phrase is a trigger with all windows that belong to it;
the phrases of a text are its parse, the distinct ones the dictionary.

Sorting the suffixes of a whole dictionary would take many times the text where little repeats, so
rounds of `exchange` leave to it only what can matter:

1. triggers: how often each occurs. One that occurs once settles all its windows.
2. the parse: phrases with a repeated trigger by name (a fingerprint), how often each occurs, and in
   which document first. A phrase that a smaller doc_id holds is removed whole; if all occurrences of
   a trigger are one phrase, that settles the first one too.
3. the dictionary of the other phrases, each distinct one of a group once, dealt by trigger: a part
   makes the suffix array of its phrases (of the suffixes that are windows, by their first `window`
   bytes), and runs of suffixes with a common prefix of that length share a least document. As equal
   windows lie in phrases of one trigger, a run is never cut by the dealing. Phrases of a trigger that
   is more frequent than HOT are dealt window by window instead, so no part grows with a frequent one.

Suffixes that tie in the dictionary would be ordered by the parse that follows them; what is removed
doesn't depend on that order, so it isn't made.

Defined results: null texts count as empty and lose nothing; a null doc_id sorts after all others;
rows with one doc_id are one document as far as "smaller" goes; repeated rows lose nothing to one
another; other columns aren't read; very long texts are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernels as K
from tessera.llm.exchange import Exchange, Question, distinct, divided, read, spans, together
from tessera.llm.frames import gathered

WINDOW, GRAM = 50, 24
#: Occurrences of a trigger in the corpus beyond which its phrases are dealt window by window.
HOT = 4096
LAST = np.iinfo(np.int64).max
U32 = np.uint64(32)


def least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` consecutive values, by doubling."""
    have, at = keys, 1
    while 2 * at <= span:
        have = np.minimum(have[: len(have) - at], have[at:])
        at *= 2
    rest = span - at
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Group:
    """The bytes of one group of documents and its phrases."""

    def __init__(self, docs: pa.Table, window: int, gram: int, hot: int):
        self.docs, self.window, self.hot = docs, window, hot
        self.buf, self.offsets = K.text_of(docs.column("text"))
        ids = docs.column("doc_id").combine_chunks()
        self.ids = np.asarray(ids.fill_null(LAST) if ids.null_count else ids, np.int64)
        n = len(self.buf)
        z = np.zeros(0, np.int64)
        self.trigger, self.lo, self.hi, self.doc, self.key = z, z, z, z, np.zeros(0, np.uint64)
        self.sums: dict[int, np.ndarray] = {}
        if n < window:
            return
        grams = self.all_hashed(gram)
        bits = np.uint64(int(n).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        keys = grams & ~low  # the leading bits, then the place from the end: of equal hashes the last is least
        keys |= np.arange(int(low), int(low) - len(grams), -1, dtype=np.uint64)
        span = window - gram + 1
        at = least(keys, span)
        lengths = np.diff(self.offsets)
        starts = np.ones(n, bool)
        short = np.flatnonzero(lengths)
        for back in range(1, window):  # no window begins among a text's last window - 1 bytes
            ends = self.offsets[1:][short] - back
            starts[ends[ends >= self.offsets[:-1][short]]] = False
        s = np.flatnonzero(starts[: n - window + 1])
        t = int(low) - (at[s] & low).astype(np.int64)
        # where the bits that made way for the place would have decided, the whole hash does
        for k in np.flatnonzero(grams[t] != least(grams, span)[s]).tolist():
            own = grams[s[k] : s[k] + span]
            t[k] = s[k] + span - 1 - int(np.argmin(own[::-1]))
        # a trigger's windows are consecutive, and a trigger belongs to one document
        new = np.ones(len(s), bool)
        new[1:] = t[1:] != t[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s))[: len(first)] - 1
        self.trigger, self.lo, self.hi = t[first], s[first], s[last]
        self.doc = np.searchsorted(self.offsets, self.lo, "right") - 1
        self.key = K.mix(grams[self.trigger])  # least hashes are small ones: mixed, they spread over all parts

    def all_hashed(self, length: int) -> np.ndarray:
        """hashed() at every place."""
        sums = self.sums[0] = K.prefix_sums(self.buf, 0)
        h = sums[length:] - sums[:-length]
        h *= K.powers(K._seeded(0)[2], len(h))
        h += np.uint64(length * 0x9E3779B97F4A7C15 % 2**64)
        return K.mix(h)

    def hashed(self, starts: np.ndarray, length, seed: int) -> np.ndarray:
        """Hashes of spans, from prefix sums that are made once per seed."""
        if seed not in self.sums:
            self.sums[seed] = K.prefix_sums(self.buf, seed)
        sums = self.sums[seed]
        back = K.powers(K._seeded(seed)[2], len(self.buf) + 1)
        length = np.asarray(length)
        return K.mix((sums[starts + length] - sums[starts]) * back[starts] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def repeated(self, replies: dict):
        """Occurrences of triggers that the corpus repeats, each with its trigger's count."""
        first, rank = distinct(self.key)
        (n,) = read(replies.get(0, []), [np.uint32], len(first))
        n = n[rank] if len(rank) else np.zeros(0, np.uint32)
        self.rank0 = first, rank
        on = np.flatnonzero(n > 1)
        return on, n[on]

    def phrases(self, on: np.ndarray):
        """Distinct phrases of these occurrences: hashes, the first row and rank of each, and the least doc_id."""
        length = self.hi[on] - self.lo[on] + self.window
        # the trigger's place is part of a phrase
        a = K.mix(self.hashed(self.lo[on], length, 1) + (self.trigger[on] - self.lo[on]).astype(np.uint64))
        b = (self.hashed(self.lo[on], length, 0) >> U32).astype(np.uint32)
        first, rank = distinct(a, b)
        ids = np.full(len(first), LAST)
        np.minimum.at(ids, rank, self.ids[self.doc[on]])
        return a, b, first, rank, ids

    def doubtful(self, replies: dict):
        """(occurrences, which are removed whole, which are in doubt, which of them have a frequent trigger)."""
        on, n = self.repeated(replies)
        _, _, first, rank, ids = self.phrases(on)
        smaller, n_phrase = read(replies.get(1, []), [np.uint8, np.uint32], len(first))
        if not len(on):
            return (on, *(np.zeros(0, bool),) * 3)
        own = self.ids[self.doc[on]]
        removed = (smaller[rank] > 0) | (own > ids[rank])
        return on, removed, ~removed & (n_phrase[rank] != n), n > self.hot

    def dictionary(self, on: np.ndarray, hot: np.ndarray):
        """Entries for doubtful occurrences: keys (sorted), start, number of windows and least doc_id of each; for each window of the occurrences its start, the place of its window among those of all entries, and whether its entry has a smaller doc_id."""
        cool, rest = on[~hot], on[hot]
        _, _, first, rank, ids = self.phrases(cool)
        n = self.hi[rest] - self.lo[rest] + 1
        s = spans(self.lo[rest], n)
        a, b = self.fingerprints(s)
        first2, rank2 = distinct(a, b)
        ids2 = np.full(len(first2), LAST)
        own = self.ids[np.repeat(self.doc[rest], n)]
        np.minimum.at(ids2, rank2, own)
        key = np.concatenate([self.key[cool[first]], a[first2]])
        start = np.concatenate([self.lo[cool[first]], s[first2]])
        size = np.concatenate([(self.hi - self.lo + 1)[cool[first]], np.ones(len(first2), np.int64)])
        order = np.argsort(key, kind="stable")
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        m = self.hi[cool] - self.lo[cool] + 1
        starts = np.concatenate([spans(self.lo[cool], m), s])
        places = np.concatenate([spans(begin[: len(first)][rank], m), begin[len(first) :][rank2]])
        later = np.concatenate([np.zeros(int(m.sum()), bool), own > ids2[rank2]])
        return key[order], start[order], size[order], np.concatenate([ids, ids2])[order], starts, places, later

    def fingerprints(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows at these places."""
        if not len(s):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return self.hashed(s, self.window, 1), (self.hashed(s, self.window, 0) >> U32).astype(np.uint32)

    def removed(self, replies: dict) -> np.ndarray:
        """Which bytes go."""
        on, whole, doubt, hot = self.doubtful(replies)
        edge = np.zeros(len(self.buf) + 1, np.int64)
        gone = on[whole]
        np.add.at(edge, self.lo[gone], 1)
        np.add.at(edge, self.hi[gone] + self.window, -1)
        _, _, size, _, starts, places, later = self.dictionary(on[doubt], hot[doubt])
        (smaller,) = read(replies.get(2, []), [np.uint8], int(size.sum()))
        s = starts[(smaller[places] > 0) | later]
        np.add.at(edge, s, 1)
        np.add.at(edge, s + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def suffix_array(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Some places of a text in the order of their next `window` bytes, and which of them have the same bytes as the one before."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    padded = np.append(text, np.zeros(7, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)  # eight bytes at each place
    keys = []
    for at in range(0, window, 8):
        word = np.ascontiguousarray(words[starts + at]).view(">u8")[:, 0].astype(np.uint64)
        if window - at < 8:
            word >>= np.uint64(8 * (8 - window + at))
        keys.append(word)
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = True
    for k in keys:
        sorted_key = k[order]
        same[1:] &= sorted_key[1:] == sorted_key[:-1]
    return order, same


def triggers(window: int, gram: int, bits: int, hot: int) -> Question:
    """How often each trigger occurs."""
    shift = 64 - bits

    def ask(docs: pa.Table, _):
        g = Group(docs, window, gram, hot)
        first, rank = distinct(g.key)
        keys = g.key[first]
        return keys, [keys >> np.uint64(shift), np.bincount(rank, minlength=len(first)).astype(np.uint32)], None

    def answer(groups: list) -> list:
        keys, n = together(groups)
        _, rank = distinct(keys)
        return divided([np.bincount(rank, weights=n).astype(np.uint32)[rank]], groups)

    return Question(ask, [np.uint64, np.uint32], answer, [np.uint32], shift)


def parse(window: int, gram: int, hot: int) -> Question:
    """Whether a smaller doc_id has the phrase, and how often it occurs."""

    def ask(docs: pa.Table, replies: dict):
        g = Group(docs, window, gram, hot)
        on, _ = g.repeated(replies)
        a, b, first, rank, ids = g.phrases(on)
        return a[first], [a[first], b[first], np.bincount(rank, minlength=len(first)).astype(np.uint32), ids], None

    def answer(groups: list) -> list:
        a, b, n, ids = together(groups)
        first, rank = distinct(a, b)
        low = np.full(len(first), LAST)
        np.minimum.at(low, rank, ids)
        return divided([(low[rank] < ids).astype(np.uint8), np.bincount(rank, weights=n).astype(np.uint32)[rank]], groups)

    return Question(ask, [np.uint64, np.uint32, np.uint32, np.int64], answer, [np.uint8, np.uint32])


def dictionary(window: int, gram: int, bits: int, hot: int) -> Question:
    """For each window of each entry, whether a smaller doc_id holds it."""
    shift = 64 - bits

    def ask(docs: pa.Table, replies: dict):
        g = Group(docs, window, gram, hot)
        on, _, doubt, frequent = g.doubtful(replies)
        keys, start, size, ids, *_ = g.dictionary(on[doubt], frequent[doubt])
        return keys, [keys >> np.uint64(shift), size.astype(np.uint8), ids], g.buf[spans(start, size + window - 1)]

    def answer(groups: list) -> list:
        _, size, ids = together(groups)
        size = size.astype(np.int64)
        bytes_of = size + window - 1
        starts = spans(np.cumsum(bytes_of) - bytes_of, size)
        order, same = suffix_array(np.concatenate([g[1] for g in groups]), starts, window)
        run = np.cumsum(~same) - 1
        owner = np.repeat(ids, size)
        least_id = np.minimum.reduceat(owner[order], np.flatnonzero(~same)) if len(order) else owner
        smaller = np.zeros(len(owner), np.uint8)
        smaller[order] = least_id[run] < owner[order]
        ends = np.cumsum([int(g[0][1].sum(dtype=np.int64)) for g in groups])[:-1]
        return [[x] for x in np.split(smaller, ends)]

    return Question(ask, [np.uint64, np.uint8, np.int64], answer, [np.uint8], shift, lambda c: c[1].astype(np.int64) + window - 1, lambda c: c[1].astype(np.int64))


def remove_repeats(
    docs: DataFrame, result, schema: str, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    hot: int = HOT, small: bool = False, **sizes,
) -> DataFrame:
    """result(docs, bytes, offsets, removed) for each group of documents: `removed` flags the bytes that a window covers which a smaller doc_id holds too.

    small: the results are few numbers of each document, and go into few files. sizes: of groups, parts, blocks and relays. A phrase has window - gram + 1 windows at most, which must be below 256.
    """
    ex = Exchange(docs, id_col, text_col, **sizes)
    for stage, question in enumerate((triggers(window, gram, ex.bits, hot), parse(window, gram, hot), dictionary(window, gram, ex.bits, hot))):
        ex.ask(stage, question)

    def last(table: pa.Table, replies: dict) -> pa.Table:
        g = Group(table, window, gram, hot)
        return result(table, g.buf, g.offsets, g.removed(replies))

    out = ex.finish(last, schema)
    return gathered(out, ex.n_bytes) if small else out


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the bytes that are left (cuts can part a character, so they are binary)."""

    def result(table: pa.Table, buf: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
        return pa.table(
            [
                table.column("doc_id"),
                pa.array([buf[a:b][~removed[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
            ],
            names=["doc_id", "text"],
        )

    return remove_repeats(docs, result, "doc_id long, text binary", window, id_col=id_col, text_col=text_col)


def digest(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    def result(table: pa.Table, buf: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
        new = removed.copy()
        new[1:] &= ~removed[:-1]
        begins = offsets[:-1][offsets[:-1] < len(removed)]
        new[begins] = removed[begins]
        shas = [hashlib.sha256(buf[a:b][~removed[a:b]]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table(
            [
                table.column("doc_id"), pa.array(np.diff(offsets)), pa.array(K.per_doc(removed, offsets)),
                pa.array(K.per_doc(new, offsets)), pa.array(shas, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return remove_repeats(docs, result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", window, small=True, **options)
