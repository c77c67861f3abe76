r"""Secret scans through nested encodings.

A worklist starts with the whole text. Each layer is scanned for the base kinds, then unwrapped in every way it allows: percent
escapes (also as a form writes them, with "+" for a space), escapes of characters (Unicode, hexadecimal, octal, those of strings such
as ``\n``, and character references by number or name), each over the layer's whole text, and base64 runs. Bytes of escapes and runs may
be text or hold gzip, zlib, bzip2, xz or zstandard streams, of any number of members, compressed any number of times; a run may also be
one deflate stream without a header. Runs are read in all four alignments, line by line and joined over line breaks, whatever the
lines' width; bytes that aren't text hide nothing beside them. What comes out is a new layer, until nothing new appears. A layer equal to one already seen over the same
part of the root text is a cycle and is dropped. A layer knows its parent and where its pieces lie in it, as intervals and not by
character, so a secret found at any depth has a span in the root text: the escape, the base64 quartets, or the compressed run.

The worklist is a stack of generators: one layer of each depth is in memory. Compressed streams are unpacked in overlapping windows,
all of which are scanned; what may be an inner stream that is open at a window's end goes into the next window from its first byte on,
so a stream in a stream is only held in full while it is encoded as text.

Defined cases: null text is empty; null ``doc_id`` stays null; repeated rows are scanned each; an empty table gives no rows; a very
long text is scanned whole, at a few times its memory; other columns, whatever their names, are kept by ``redact`` and ignored by
``scan``.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import urllib.parse
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.entities import html5
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_FORM = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
_ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|[\\%]u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\([0-3][0-7]{2})|\\([abfnrtv\"'/\\])|&([A-Za-z][A-Za-z0-9]{1,31});"
)
_REFERENCE = re.compile("&#|&[A-Za-z][A-Za-z0-9]{1,31};")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# A run and the lines after it, or lines that are all shorter than a run.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t>]*[A-Za-z0-9+/_-]+)*={0,2}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,15}+(?:\r?\n[\x20\t>]*[A-Za-z0-9+/_-]{1,15}+)+={0,2}")
_WINDOW, _OVERLAP = 1 << 22, 1 << 12
_BASE64_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n\t >"
_NO_BREAKS = str.maketrans("-_", "+/", "\r\n\t >")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The three kinds in ``text``: (start, kind, end), by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text, the layer that it was unwrapped from, and ``place``: its interval [a, b) -> the interval there."""

    __slots__ = ("text", "parent", "place")

    def __init__(self, text: str, parent: _Layer | None = None, place: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.parent, self.place = text, parent, place

    def root(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            a, b = layer.place(a, b)
            layer = layer.parent
        return a, b

    def key(self) -> tuple:
        whole = self.root(0, len(self.text)) if self.text else (0, 0)
        return (*whole, hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())


class _Pieces:
    """Where the characters of a layer come from: pieces whose characters stand for ``step`` characters of the parent each."""

    def __init__(self):
        self.at, self.start, self.step, self.size, self.end = array("q"), array("q"), array("q"), 0, 0

    def add(self, n: int, start: int, step: int) -> None:
        """``n`` characters from the parent's position ``start`` on; a piece that goes on as the last one did is part of it."""
        if n and not (self.at and self.step[-1] == step and self.end == start):
            self.at.append(self.size)
            self.start.append(start)
            self.step.append(step)
        self.size, self.end = self.size + n, start + n * step

    def place(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        return self.start[i] + (a - self.at[i]) * self.step[i], self.start[j] + (b - self.at[j]) * self.step[j]


def _replaced(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with each match of ``pattern`` decoded; ``decode``: match -> (text, [(characters, step)]), or None to leave it."""
    out, pieces, at = [], _Pieces(), 0
    for m in pattern.finditer(layer.text):
        if (got := decode(m)) is None:
            continue
        text, parts = got
        out += [layer.text[at : m.start()], text]
        pieces.add(m.start() - at, at, 1)
        at = m.start()
        for n, step in parts:
            pieces.add(n, at, step)
            at += n * step
    if not out:
        return None
    out.append(layer.text[at:])
    pieces.add(len(layer.text) - at, at, 1)
    return _Layer("".join(out), layer, pieces.place)


def _percent(m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    raw = bytes.fromhex(m[0].replace("%", ""))
    if raw.isascii():
        return raw.decode(), [(len(raw), 3)]
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), [(len(raw), 3)]
    return text, [(len(list(run)), 3 * n) for n, run in groupby(len(c.encode()) for c in text)]


def _form(m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    return (" ", [(1, 1)]) if m[0] == "+" else _percent(m)


def _escape(m: re.Match) -> tuple[str, list[tuple[int, int]]] | None:
    if m[8] or m[9]:
        text = _NAMED.get(m[8], m[8]) if m[8] else html5.get(f"{m[9]};", "")
        return (text, [(1, m.end() - m.start())]) if len(text) == 1 else None
    code = int(m[6]) if m[6] else int(m[7], 8) if m[7] else int(next(g for g in m.groups() if g), 16)
    return (chr(code), [(1, m.end() - m.start())]) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


_STREAMS = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    (b"BZh", bz2.BZ2Decompressor),
    (b"\xfd7zXZ\x00", lzma.LZMADecompressor),
    (b"\x28\xb5\x2f\xfd", lambda: zstandard.ZstdDecompressor().decompressobj()),
    (b"\x78\x01", zlib.decompressobj),
    (b"\x78\x5e", zlib.decompressobj),
    (b"\x78\x9c", zlib.decompressobj),
    (b"\x78\xda", zlib.decompressobj),
)


_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|x[\x01\x5e\x9c\xda]")


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What comes out of one compressed stream after the other; none if ``pieces`` doesn't begin with one."""
    machine, rest = None, b""
    try:
        for piece in pieces:
            # Small steps in: one step's output is bounded by the format's greatest ratio.
            for at in range(0, len(piece), 256):
                rest += piece[at : at + 256]
                while rest:
                    if machine is None:
                        stream = next((s for magic, s in _STREAMS if rest.startswith(magic)), None)
                        if stream is None and len(rest) >= 6:
                            return
                        if stream is None:
                            break
                        machine = stream()
                    out, rest = machine.decompress(rest), b""
                    if out:
                        yield out
                    if getattr(machine, "eof", False):
                        rest, machine = machine.unused_data.lstrip(b"\0"), None  # members may be padded
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        pass  # what came out before the damage counts


def _open_at_end(text: str) -> int:
    """How many of the last characters may be a compressed stream, written as text, that goes on behind ``text``."""
    kept = 0
    run = text[len(text.rstrip(_BASE64_CHARS)) :]
    plain = run.translate(_NO_BREAKS)
    for k in range(4):
        own = plain[k : len(plain) - (len(plain) - k) % 4].replace("=", "A")
        if m := _MAGIC.search(base64.b64decode(own, validate=False)):
            # A break in the run only makes the part before it longer.
            kept = max(kept, len(run) - (k + m.start() // 3 * 4))
    for pattern, mark in ((_PERCENT_STREAM, "%"), (_ESCAPED_STREAM, "\\x")):
        if mark in text:
            kept = max(kept, *(len(text) - m.start() for m in pattern.finditer(text) if m.end() == len(text)), 0)
    return kept


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """The text of ``pieces`` in overlapping windows; what may be an open stream at a window's end goes into the next in full."""
    decoder, parts, size, enough = codecs.getincrementaldecoder("utf-8")("replace"), [], 0, _WINDOW
    for piece in pieces:
        parts.append(decoder.decode(piece))
        size += len(parts[-1])
        if size >= enough:
            text = "".join(parts)
            kept = _open_at_end(text)
            if kept > size // 2:
                parts, enough = [text], 2 * size
                continue
            yield text
            parts = [text[-max(_OVERLAP, kept) :]]
            size, enough = len(parts[0]), _WINDOW + kept
    if parts:
        yield "".join(parts) + decoder.decode(b"", True)


def _unpacked(data: bytes | memoryview) -> Iterator[str]:
    """Windows of the text in a compressed stream, and in what is compressed in it in turn; none if ``data`` isn't one."""
    seen = set()
    inner = lambda: _members(iter([data]))
    while True:
        digest, head, wide = hashlib.blake2b(digest_size=16), b"", False
        for piece in inner():
            digest.update(piece)
            head = (head + piece)[:6] if len(head) < 6 else head
            wide = wide or b"\0" in piece
        if not head or digest.digest() in seen:  # a stream that holds itself
            return
        seen.add(digest.digest())
        yield from _windows(inner())
        if wide:
            for name in ("utf-16-le", "utf-16-be"):
                decoder = codecs.getincrementaldecoder(name)("replace")
                yield from _windows(decoder.decode(x).encode("utf-8", "replace") for x in inner())
        if not any(head.startswith(magic) for magic, _ in _STREAMS):
            return
        inner = lambda outer=inner: _members(outer())


def _streams(data: bytes) -> Iterator[str]:
    """Windows of all compressed streams that begin anywhere in ``data``."""
    whole = memoryview(data)
    for m in _MAGIC.finditer(data):
        if data[m.start()] == 0x78:
            # Two bytes are soon met by chance: a look at the first few that follow.
            try:
                zlib.decompressobj().decompress(whole[m.start() : m.start() + 16])
            except zlib.error:  # damage in the first step, which lets nothing out
                continue
        yield from _unpacked(whole[m.start() :])


def _bare(data: bytes) -> Iterator[str]:
    """Windows of the text of ``data`` if all of it is one deflate stream without a header."""

    def pieces() -> Iterator[bytes]:
        machine = zlib.decompressobj(-15)
        for at in range(0, len(data), 256):
            if out := machine.decompress(data[at : at + 256]):
                yield out
        if not machine.eof or machine.unused_data:
            raise zlib.error

    try:
        for _ in pieces():
            pass
    except zlib.error:
        return
    yield from _windows(pieces())


_PERCENT_STREAM = re.compile(r"(?i:%1f%8b%08|(?:B|%42)(?:Z|%5a)(?:h|%68)[1-9%]|%fd(?:7|%37)(?:z|%7a)|(?:\(|%28)%b5(?:/|%2f)%fd|(?:x|%78)(?:%01|%5e|\^|%9c|%da))[^\s\"<>&]*")
_ESCAPED_STREAM = re.compile(r"(?:\\x1[fF]\\x8[bB]\\(?:x08|b)|(?:B|\\x42)(?:Z|\\x5[aA])(?:h|\\x68)[1-9\\]|\\x[fF][dD](?:7|\\x37)(?:z|\\x7[aA])|(?:\(|\\x28)\\x[bB]5(?:/|\\x2[fF])\\x[fF][dD]|(?:x|\\x78)(?:\\x(?:01|5[eE]|9[cC]|[dD][aA])|\^))[\x20-\x7e]*")
_ESCAPED_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([abfnrtv0'\"\\])")
_NAMED = dict(zip("abfnrtv0'\"\\", "\a\b\f\n\r\t\v\0'\"\\", strict=True))


def _all_of(start: int, end: int) -> Callable[[int, int], tuple[int, int]]:
    return lambda a, b: (start, end)


def _escaped_streams(layer: _Layer) -> Iterator[_Layer]:
    """Compressed streams whose bytes are written in percent or ``\\x`` escapes, the printable ones as themselves."""
    if "%" in layer.text:
        for m in _PERCENT_STREAM.finditer(layer.text):
            for text in _streams(urllib.parse.unquote_to_bytes(m[0].encode("utf-8", "surrogateescape"))):
                yield _Layer(text, layer, _all_of(m.start(), m.end()))
    if "\\x" in layer.text:
        for m in _ESCAPED_STREAM.finditer(layer.text):
            raw = _ESCAPED_BYTE.sub(lambda x: chr(int(x[1], 16)) if x[1] else _NAMED[x[2]], m[0]).encode("latin-1")
            for text in _streams(raw):
                yield _Layer(text, layer, _all_of(m.start(), m.end()))


def _telling(text: str) -> bool:
    """Whether ``text`` can hold a secret or another layer."""
    low = text.lower()
    return any(h in low for h in (*_ASSIGN_HINTS, "akia", "%", "\\")) or bool(_HEX.search(text) or _WRAPPED.search(text) or _REFERENCE.search(text))


class _Bytes:
    """How many bytes the first characters of ``text`` have, by counts that are taken once for each block of it."""

    __slots__ = ("text", "name", "errors", "blocks")
    SIZE = 512

    def __init__(self, text: str, name: str, errors: str):
        self.text, self.name, self.errors, self.blocks = text, name, errors, None

    def before(self, i: int) -> int:
        if self.name == "utf-8" and self.text.isascii():
            return i
        if self.blocks is None:
            self.blocks = array("q", [0])
            for at in range(0, len(self.text), self.SIZE):
                self.blocks.append(self.blocks[-1] + self._count(at, at + self.SIZE))
        block = min(i // self.SIZE, len(self.blocks) - 1)
        return self.blocks[block] + self._count(block * self.SIZE, i)

    def _count(self, a: int, b: int) -> int:
        return len(self.text[a:b].encode(self.name, self.errors))


def _texts(data: bytes) -> Iterator[tuple[str, _Bytes]]:
    """Readings of ``data`` as text, with what counts a text's bytes. Bytes that aren't text become lone surrogates or marks."""
    for name, errors in (("utf-8", "surrogateescape"), *((("utf-16-le", "surrogatepass"), ("utf-16-be", "surrogatepass")) if b"\0" in data else ())):
        text = data.decode(name, "replace" if name != "utf-8" else errors)
        if _telling(text):
            yield text, _Bytes(text, name, errors)


def _base64(layer: _Layer) -> Iterator[_Layer]:
    for m in _WRAPPED.finditer(layer.text):
        # A run of one line, or one over line breaks: each of its lines, and all as one.
        runs = [range(x.start() + m.start(), x.end() + m.start()) for x in _RUN.finditer(m[0])]
        if "\n" in m[0] and len(m[0].translate(_NO_BREAKS)) >= 16:
            runs.append(array("q", (i for i, c in enumerate(m[0], m.start()) if c not in "\r\n\t >")))
        for places in runs:
            body = layer.text[places.start : places.stop] if isinstance(places, range) else m[0].translate(_NO_BREAKS)
            body = body.rstrip("=").replace("-", "+").replace("_", "/")
            if "=" in body:
                continue  # padding inside: each line is a run of its own
            # The payload may begin anywhere, as behind a path's slash, so all four alignments are read.
            for k in range(4):
                own = body[k:]
                own = own[:-1] if len(own) % 4 == 1 else own
                data = base64.b64decode(own + "=" * (-len(own) % 4))
                for text in _streams(data):
                    yield _Layer(text, layer, _all_of(places[0], places[-1] + 1))
                if k == 0:
                    for text in _bare(data):
                        yield _Layer(text, layer, _all_of(places[0], places[-1] + 1))
                for text, size in _texts(data):

                    def place(a: int, b: int, size=size, k=k, places=places) -> tuple[int, int]:
                        first, last = size.before(a), size.before(b) - 1
                        return places[min(k + first // 3 * 4, len(places) - 1)], places[min(k + last // 3 * 4 + 4, len(places)) - 1] + 1

                    yield _Layer(text, layer, place)


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    if "%" in layer.text and (new := _replaced(layer, _PERCENT, _percent)):
        yield new
        if "+" in layer.text:
            yield _replaced(layer, _FORM, _form)
    if ("\\" in layer.text or "&" in layer.text or "%u" in layer.text) and (new := _replaced(layer, _ESCAPE, _escape)):
        yield new
    yield from _escaped_streams(layer)
    yield from _base64(layer)


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that unwrapping adds."""
    text = text or ""
    base = base_spans(text)
    found, seen = set(base), set()
    work = [_unwrapped(_Layer(text))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        for a, kind, b in base_spans(layer.text):
            start, end = layer.root(a, b)
            found.add((start, kind, end))
        work.append(_unwrapped(layer))
    return base, sorted(found)


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, counts of base spans by kind, ``base`` and ``spans`` as kind:start:end lists."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans = scan_text(t.as_py())
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), _named(base), _named(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """``text`` with every span replaced by ``mark``; overlapping spans become one."""
    spans = scan_text(text)[1] if text else []
    if not spans:
        return text
    out, at = [], 0
    while spans:
        start, _, end = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[2])
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(df: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with its ``text`` redacted; all its rows and columns stay."""
    at = df.columns.index("text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t.as_py(), mark) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(cleaned, df.schema)


def op7_recursive_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
