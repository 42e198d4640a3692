"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once per worker, by encoding every one
of them with the merges of the vocabulary itself. A text is then cut into pre-tokens; those that are
such strings count as one token without any merging, and only the rest goes through the merges
(their counts are kept in a bounded table).

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens inside
texts are one token each, as is the library's default; null ids pass through; repeated rows are counted
one by one; very long texts are counted whole, some pre-tokens at a time; other columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.frames import arrow_rows, map_text

#: What the library's byte-level pre-tokenizer cuts texts into, with \s as Unicode's White_Space.
WHITE = r"\x09-\x0D\x20\x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pre-tokens outside the vocabulary whose counts a worker remembers.
REMEMBERED = 200_000
#: Characters of a text whose pre-tokens are listed at once, and pre-tokens of a longer one.
LONG = 1 << 17


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        to_letters = {chr(b): c for b, c in letters.items()}
        back = {c: b for b, c in letters.items()}
        model, self.rest = tokenizer.model, {}
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(PATTERN)
        self.merge = lambda word: len(model.tokenize("".join(to_letters[chr(b)] for b in word.encode())))
        #: The proof: strings that are valid text and that the merges put together to a single token.
        self.whole = {}
        for letter_string in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
            raw = bytes(back[c] for c in letter_string)
            try:
                word = raw.decode()
            except UnicodeDecodeError:
                continue
            if len(model.tokenize(letter_string)) == 1:
                self.whole[word] = 1

    def pretokens(self, text: str) -> int:
        if len(text) <= LONG:
            return self.merged(self.words.findall(text))
        found, n = (m[0] for m in self.words.finditer(text)), 0
        while words := list(islice(found, LONG)):
            n += self.merged(words)
        return n

    def merged(self, words: list[str]) -> int:
        """Tokens of some pre-tokens."""
        known = list(map(self.whole.get, words))
        missing = known.count(None)
        if not missing:
            return len(words)
        n = len(words) - missing
        for word, k in zip(words, known, strict=True):
            if k is None:
                count = self.rest.get(word)
                if count is None:
                    count = self.merge(word)
                    if len(self.rest) >= REMEMBERED:
                        self.rest.clear()
                    if len(word) <= 64:
                        self.rest[word] = count
                n += count
        return n

    def count(self, text: str) -> int:
        if self.special is None:
            return self.pretokens(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.pretokens, parts))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether a document has more than `limit` tokens."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(vocabulary).count
        texts = [t or "" for t in part.column("text").to_pylist()]
        n = [count(t) for t in texts]
        return arrow_rows(
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            [part.column("doc_id"), [len(t.encode()) for t in texts], n, [k > limit for k in n]],
            [pa.int64(), pa.int64(), pa.int64(), pa.bool_()],
        )

    return map_text(docs, id_col, text_col, kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
