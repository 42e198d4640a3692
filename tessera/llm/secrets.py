"""Secret scans with a worklist of decoded layers.

A text is the first layer. Percent escapes, and Unicode escapes and character entities, are decoded in
place, base64 runs (and compressed data in them) become layers of their own; each new layer goes on the
worklist and is scanned and decoded like the first until nothing new appears. A text is decoded once in
a document, so cycles end, but what it holds is reported at every place where it stands. A layer of
which all escapes are decoded, until none is left, is always among them; the layers between are, too,
as long as each is shorter than the one before by a SHRINK-th, so that work stays in proportion to the
text however deep escapes are nested. Every layer knows which
characters of the original text each of its characters came from, and what it holds is reported as
spans of the original. Decompressed data is read to its end, through all its members, in windows.

Defined results: null texts count as empty; empty texts have no spans; null ids pass through;
repeated rows are scanned one by one; very long texts are scanned whole; other columns aren't read (redact
keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import binascii
import bz2
import gzip
import hashlib
import html
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm import kernels as K
from tessera.llm.frames import arrow_rows, bounded, map_text, number_of, numbered

KINDS = ("assign", "access", "hex")
#: Bytes that are read from compressed data at once, bytes of a window of it, and bytes that tell whether it is compressed again.
CHUNK, WINDOW, HEAD = 1 << 16, 1 << 20, 16
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = (b"passw", b"secret", b"token", b"api")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ONE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};"
ESCAPE = re.compile(f"(?:{ONE})+")
ONE_ESCAPE = re.compile(r"\\u\{?([0-9A-Fa-f]+)\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|(&#[xX]?[0-9A-Fa-f]+;|&[A-Za-z][A-Za-z0-9]*;)")
#: One escape of any kind, with all that it was escaped by again (%2541, &amp;amp;lt;), and the most characters of one.
NESTED = re.compile(rf"%(?:25)*[0-9A-Fa-f]{{2}}|&(?:amp;)+(?=#?[A-Za-z0-9]{{1,32}};)|{ONE}")
LONGEST = 36
#: By what part of itself a layer must get shorter for the layers between it and its last one to be looked at.
SHRINK = 64
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
WRAP = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
CONTROLS = bytes({*range(32), 127} - {9, 10, 13})
UTF16 = re.compile(rb"[\x01-\x7f]?(?:\0[\x01-\x7f]){7,}")
#: Places inside no secret, escape, base64 run (wrapped or not) or UTF-16 word.
CUT = re.compile(rb"""[^A-Za-z0-9+/_=.\-"'\x20\t\r\n:%\\{}&#;>\0]|(?<=[0-9A-Za-z])\x20(?=[0-9A-Za-z])|\0\0\0""")
LETTERS = K.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
HEX_BYTES, BASE64_BYTES = K.byte_class(b"0123456789abcdef"), K.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one layer: (kind, start, end) in code points."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text and where it came from: segments (from, original start, original end, one to one)."""

    def __init__(self, text: str, segments: list[tuple[int, int, int, bool]]):
        self.text, self.segments = text, segments
        self.begins = [s[0] for s in segments]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        a = self.segments[bisect_right(self.begins, start) - 1]
        b = self.segments[bisect_right(self.begins, end - 1) - 1]
        return (a[1] + start - a[0] if a[3] else a[1]), (b[1] + end - b[0] if b[3] else b[2])


def substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each run of escapes replaced by its characters; decode gives (character, length of its escape) for a run, or None."""
    parts, segments, at, size = [], [], 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal size
        k = bisect_right(layer.begins, a) - 1
        while a < b:
            begin, start, end, exact = layer.segments[k]
            to = min(b, layer.begins[k + 1] if k + 1 < len(layer.begins) else b)
            segments.append((size, start + a - begin, end, True) if exact else (size, start, end, False))
            parts.append(layer.text[a:to])
            size += to - a
            a, k = to, k + 1

    changed = False
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        keep(at, m.start())
        place = m.start()
        for char, length in got:
            start, end = layer.origin(place, place + length)
            segments.append((size, start, end, False))
            parts.append(char)
            size += len(char)
            place += length
        at, changed = m.end(), True
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), segments)


def percent(run: str) -> list[tuple[str, int]] | None:
    try:
        return [(c, 3 * len(c.encode())) for c in bytes.fromhex(run.replace("%", "")).decode()]
    except UnicodeDecodeError:
        return [(chr(int(run[i + 1 : i + 3], 16)), 3) for i in range(0, len(run), 3)]


def escapes(run: str) -> list[tuple[str, int]] | None:
    out: list[tuple[str, int]] = []
    for m in ONE_ESCAPE.finditer(run):
        code = m[1] or m[2] or m[3]
        if m[4]:
            char = html.unescape(m[4])  # an unknown name stays as it is
        elif int(code, 16) > 0x10FFFF:
            return None
        else:
            char = chr(int(code, 16))
        if out and len(char) == 1 and 0xDC00 <= ord(char) < 0xE000 and 0xD800 <= ord(out[-1][0][-1:] or "a") < 0xDC00:
            high, length = out.pop()
            char, m_len = chr(0x10000 + ((ord(high) - 0xD800) << 10) + ord(char) - 0xDC00), length + len(m[0])
        else:
            m_len = len(m[0])
        out.append((char, m_len))
    return out


class Inflated(io.RawIOBase):
    """The content of zlib data in a file."""

    def __init__(self, file):
        self.file, self.inflate, self.left = file, zlib.decompressobj(), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.inflate.eof:
            data = self.left or self.file.read(CHUNK)
            if not data:
                break
            got = self.inflate.decompress(data, len(into))
            self.left = self.inflate.unconsumed_tail
            if got:
                into[: len(got)] = got
                return len(got)
        return 0


def opened(file, magic: bytes):
    """A file of what compressed data holds, all members or frames of it."""
    if magic[:1] == b"\x1f":
        return gzip.GzipFile(fileobj=file)
    if magic[:1] == b"B":
        return bz2.BZ2File(file)
    if magic[:1] == b"\xfd":
        return lzma.LZMAFile(file)
    if magic[:1] == b"\x28":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True, closefd=False))
    return io.BufferedReader(Inflated(file))


def chunks(data: bytes, place: int, magics: list[bytes], ended: list[bool]):
    """What is read from compressed data in the data, up to its end or to damage."""
    file = io.BytesIO(data)
    file.seek(place)
    try:
        for magic in magics:
            file = opened(file, magic)
        while got := file.read1(CHUNK):
            yield got
        ended.append(True)
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        pass  # what came before the damage counts


def windows(parts):
    """The parts joined to windows of WINDOW bytes or more, cut only where nothing that is looked for can go on."""
    held, size, searched, need = [], 0, 1, WINDOW
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= need:
            data, cut = b"".join(held), 0
            for back in (1 << 12, 1 << 16, size):
                for m in CUT.finditer(data, max(size - back, searched)):
                    cut = m.start() + 1
                if cut:
                    break
            if cut:
                yield data[:cut]
            # an unbroken run is held whole, however long
            held, size = [data[cut:]], size - cut
            searched, need = max(size, 1), max(WINDOW, 2 * size)
    if held:
        yield b"".join(held)


def unpacked(data: bytes):
    """Windows of all that compressed data in the data holds, of data compressed in it too."""
    at = 0
    while m := MAGIC.search(data, at):
        at, magics, seen = m.start() + 1, [m[0]], set()
        while True:
            sha, head, ended = hashlib.sha1(), b"", []

            def noted(parts):
                nonlocal head
                for part in parts:
                    sha.update(part)
                    head = head if len(head) >= HEAD else head + part[:HEAD]
                    yield part

            yield from windows(noted(chunks(data, m.start(), magics, ended)))
            if len(magics) == 1 and ended and m[0][:1] == b"\x1f":
                at = len(data)  # its members reach to the end; of other formats that isn't known
            inner = MAGIC.match(head)
            if inner is None or sha.digest() in seen:
                break
            seen.add(sha.digest())
            magics.append(inner[0])


def views(data: bytes):
    """Texts of bytes. All that is looked for is ASCII, so one byte a character will do for UTF-8 and any other data; words of UTF-16 come beside it."""
    yield data.decode("latin-1")
    if wide := [m[0].replace(b"\0", b"") for m in UTF16.finditer(data)]:
        yield b"\0".join(wide).decode("latin-1")


def readable(text: str) -> bool:
    """Whether a text of a layer, or the bytes that its characters stand for, look like text."""
    try:
        data = text.encode("latin-1")
        data.decode()
    except UnicodeEncodeError:
        data = text.encode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return len(data.translate(None, CONTROLS)) >= max(0.95 * len(data), 1)


def character(escape: str) -> str | None:
    """What one match of NESTED stands for; None if it is no escape."""
    if escape[0] == "%":
        return chr(int(escape[-2:], 16))
    if escape[0] == "&":
        if escape.endswith("amp;") and escape.count("&") == 1 and len(escape) > 5 or escape == "&amp;":
            return "&"
        return got if (got := html.unescape(escape)) != escape else None
    code = int(escape.strip("\\uUx{}"), 16)
    return chr(code) if code <= 0x10FFFF else None


class Unwrapper:
    """Decodes escapes in one pass over a layer, also those that decoding makes."""

    def __init__(self, layer: Layer):
        self.layer, self.text, self.at, self.changed = layer, layer.text, 0, False
        #: What is finished: spans of the layer that stay as they are, and characters with the span that they stand for.
        self.done: list[tuple[str, int, int, bool]] = []
        #: The last characters of the result, LONGEST at most: a later character can still make an escape of them.
        self.tail: deque[tuple[str, int, int, bool]] = deque()

    def settle(self, leave: int) -> None:
        while len(self.tail) > leave:
            char, a, b, plain = self.tail.popleft()
            if plain and self.done and self.done[-1][3] and self.done[-1][2] == a:
                a = self.done.pop()[1]
            self.done.append(("" if plain else char, a, b, plain))

    def copy(self, to: int) -> None:
        """Takes over the layer's text up to a place."""
        if to - self.at > LONGEST:
            self.settle(0)
            self.done.append(("", self.at, to - LONGEST, True))
            self.at = to - LONGEST
        self.tail.extend((self.text[k], k, k + 1, True) for k in range(self.at, to))
        self.at = to
        self.settle(LONGEST)

    def push(self, chars: str, begin: int) -> None:
        """Puts down what an escape stands for that began there, and decodes what that completes."""
        for n, char in enumerate(chars):
            self.tail.append((char, begin, self.at, False))
            if n == len(chars) - 1:
                self.settle(LONGEST)
            window = "".join(c for c, *_ in self.tail)
            size = len(window)
            window += chars[n + 1 :] + self.text[self.at : self.at + LONGEST]
            for k in range(size):
                m = NESTED.match(window, k) if window[k] in "%&\\" else None
                if m and m.end() >= size and (new := character(m[0])) is not None:
                    begin = min(begin, *(a for _, a, _, _ in list(self.tail)[k:]))
                    for _ in range(size - k):
                        self.tail.pop()
                    rest = chars[n + 1 :][m.end() - size :]
                    self.at += max(0, m.end() - size - len(chars[n + 1 :]))
                    return self.push(new + rest, begin) if len(new + rest) > 1 else self.again(new, begin)
        return None

    def again(self, char: str, begin: int) -> None:
        """push() of one character, by a loop, for chains of any length."""
        while True:
            self.tail.append((char, begin, self.at, False))
            self.settle(LONGEST)
            window = "".join(c for c, *_ in self.tail)
            size = len(window)
            window += self.text[self.at : self.at + LONGEST]
            for k in range(size):
                m = NESTED.match(window, k) if window[k] in "%&\\" else None
                if m and m.end() >= size and (new := character(m[0])) is not None:
                    break
            else:
                return
            begin = min(begin, *(a for _, a, _, _ in list(self.tail)[k:]))
            for _ in range(size - k):
                self.tail.pop()
            self.at += m.end() - size
            if len(new) > 1:
                return self.push(new, begin)
            char = new

    def run(self) -> Layer | None:
        while m := NESTED.search(self.text, self.at):
            char = character(m[0])
            self.copy(m.start() if char is not None else m.start() + 1)
            if char is not None:
                self.at, self.changed = m.end(), True
                if len(char) > 1:
                    self.push(char, m.start())
                else:
                    self.again(char, m.start())
        if not self.changed:
            return None
        self.copy(len(self.text))
        self.settle(0)
        parts, segments, size, layer = [], [], 0, self.layer
        for char, a, b, plain in self.done:
            if not plain:
                segments.append((size, *layer.origin(a, b), False))
                parts.append(char)
                size += len(char)
                continue
            parts.append(self.text[a:b])
            k = bisect_right(layer.begins, a) - 1
            while a < b:
                begin, start, end, exact = layer.segments[k]
                to = min(b, layer.begins[k + 1] if k + 1 < len(layer.begins) else b)
                segments.append((size, start + a - begin, end, True) if exact else (size, start, end, False))
                size += to - a
                a, k = to, k + 1
        return Layer("".join(parts), segments)


def substitutions(layer: Layer):
    """The layer with its percent escapes decoded, with its other escapes decoded, and with all decoded until none is left; each with whether to go on from it."""
    by_percent = substituted(layer, PERCENT, percent) if "%" in layer.text else None
    by_escape = substituted(layer, ESCAPE, escapes) if "\\" in layer.text or "&" in layer.text else None
    for new in (by_percent, by_escape):
        if new:
            yield new, SHRINK * len(new.text) <= (SHRINK - 1) * len(layer.text)
    if by_percent or by_escape:
        both = (substituted(by_percent, ESCAPE, escapes) if by_escape else by_percent) if by_percent else by_escape
        if both is not None and not any(character(m[0]) for m in NESTED.finditer(both.text)):
            yield both, False  # nothing is left
        elif left := Unwrapper(layer).run():
            yield left, False


def texts_in(run: str):
    """The texts that a base64 run holds, whichever of its first four characters the groups begin with."""
    run = run.rstrip("=").translate({45: 43, 95: 47})
    for k in range(4):
        size = len(run) - k
        size -= size % 4 == 1
        data = binascii.a2b_base64(run[k : k + size] + "=" * (-size % 4))
        yield from views(data)
        for window in unpacked(data):
            yield from views(window)


def encoded_runs(text: str):
    """(start, end, run) of what may be base64: each run, and lines of one width (the first and last may have another) joined."""
    after = 0
    for m in BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
        if m.start() < after:
            continue
        lines, end, width = [m[0]], m.end(), 0
        while lines[-1][-1] != "=" and (gap := WRAP.match(text, end)) and (line := LINE.match(text, gap.end())):
            size = len(line[0].rstrip("="))
            if width and size > width:
                break
            lines.append(line[0])
            end = line.end()
            if size < (width or 16):
                break
            width = size
        if len(lines) > 1:
            yield m.start(), end, "".join(lines)
            after = end


def key_of(text: str) -> bytes:
    return hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()


class Inside:
    """What base64 runs of one document hold. Each distinct run and text is decoded and searched once; all that is in a run counts for the whole run, wherever it stands."""

    def __init__(self):
        self.runs: dict[str, list[bytes]] = {}  # keys of the texts in a run
        self.texts: dict[bytes, tuple[set[str], list[list[bytes]]]] = {}  # by key: kinds found, keys of inner texts
        self.known: dict[str, set[str]] = {}
        self.readable = 0  # texts that look like text

    def texts_of(self, run: str):
        if run not in self.runs:
            keys = self.runs[run] = []
            for text in texts_in(run):
                keys.append(key_of(text))
                yield keys[-1], text

    def children(self, text: str, inner: list[list[bytes]]):
        for new, _ in substitutions(Layer(text, [(0, 0, 1, False)])):
            inner.append([key_of(new.text)])
            yield inner[-1][0], new.text
        for _, _, run in encoded_runs(text):
            yield from self.texts_of(run)
            inner.append(self.runs[run])

    def kinds(self, run: str) -> set[str]:
        if run in self.known:
            return self.known[run]
        stack = [self.texts_of(run)]
        while stack:
            if (got := next(stack[-1], None)) is None:
                stack.pop()
            elif got[0] not in self.texts:
                inner: list[list[bytes]] = []
                self.readable += readable(got[1])
                self.texts[got[0]] = {kind for kind, _, _ in find(got[1])}, inner
                stack.append(self.children(got[1], inner))
        out, seen, work = set(), set(), list(self.runs[run])
        while work:
            if (key := work.pop()) not in seen:
                seen.add(key)
                kinds, inner = self.texts[key]
                out |= kinds
                work += [k for keys in inner for k in keys]
        self.known[run] = out
        return out


def scan(text: str) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]], int]:
    """Base spans, all spans, and the number of layers that look like text."""
    base = find(text)
    first = Layer(text, [(0, 0, len(text), True)])
    spans, seen, inside = set(base), {(key_of(text), hash(tuple(first.segments)))}, Inside()
    work = [(first, True)]
    while work:
        layer, deep = work.pop()
        for start, end, run in encoded_runs(layer.text):
            if kinds := inside.kinds(run):
                spans.update((kind, *layer.origin(start, end)) for kind in kinds)
        if not deep:
            continue
        for new, on in substitutions(layer):
            key = key_of(new.text), hash(tuple(new.segments))
            if key not in seen:
                seen.add(key)
                spans.update((kind, *new.origin(a, b)) for kind, a, b in find(new.text))
                work.append((new, on))
    return base, spans, len(seen) + inside.readable


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, k, b, kind in sorted((a, KINDS.index(kind), b, kind) for kind, a, b in spans))


def suspicious(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that can hold a span or a layer at all: long hex or base64 runs, escapes, or the words of a rule."""

    def runs(table: np.ndarray, least: int) -> np.ndarray:
        inside = table[buf]
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(inside, out=sums[1:])
        return np.flatnonzero(sums[least:] - sums[:-least] == least) if len(buf) >= least else np.zeros(0, np.int64)

    marks = np.concatenate(
        [
            runs(BASE64_BYTES, 16), np.flatnonzero((buf == 37) | (buf == 92)),
            np.flatnonzero((buf[:-1] == 38) & ((buf[1:] == 35) | LETTERS[buf[1:]])) if len(buf) else np.zeros(0, np.int64),
        ]
    )
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, marks, "right") - 1] = True
    raw = buf.tobytes().lower()
    for word in (*WORDS, b"akia"):
        at = raw.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            out[d] = True
            at = raw.find(word, int(offsets[d + 1]))
    return out


def rows_of(part: pa.RecordBatch) -> list[tuple]:
    """(text, base spans, all spans, layers) of each document."""
    look = suspicious(*K.text_of(part.column("text")))
    return [(t, *scan(t)) if s else (t, [], set(), 1) for t, s in zip((t or "" for t in part.column("text").to_pylist()), look.tolist(), strict=True)]


def digest(docs: DataFrame) -> DataFrame:
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows_of(part)
        n = lambda base, kind: sum(s[0] == kind for s in base)
        columns = [[n(r[1], kind) for r in rows] for kind in KINDS]
        return arrow_rows(
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            [part.column("doc_id"), *columns, [hashlib.sha256(joined(r[1]).encode()).hexdigest() for r in rows], [joined(r[2]) for r in rows]],
            [pa.int64()] * 4 + [pa.string()] * 2,
        )

    return map_text(docs, "doc_id", "text", kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with secrets in the text replaced; null texts stay null. An n_chars column, if there is one, follows."""
    bounded(docs.sparkSession)
    rows, text, length = numbered(docs), number_of(docs, text_col), number_of(docs, "n_chars") if "n_chars" in docs.columns else None
    names = rows.columns

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, text):
                texts = part.column(text)
                look = suspicious(*K.text_of(texts))
                new = [t if t is None or not s else redacted(t, scan(t)[1]) for t, s in zip(texts.to_pylist(), look.tolist(), strict=True)]
                columns = list(part.columns)
                columns[names.index(text)] = pa.array(new, texts.type)
                if length:
                    old = part.column(length)
                    columns[names.index(length)] = pa.array([o if o is None or t is None else len(t) for o, t in zip(old.to_pylist(), new, strict=True)], old.type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
