"""Secret scans through encodings: a worklist of layers, each rescanned, with spans mapped back.

The first layer is the text. From each layer come others: the layer with its URL escapes undone, the
layer with its Unicode escapes undone, and one layer for each base64 run, in one line or in lines of one
width, that holds text or compressed data (gzip, zlib, bzip2, xz, zstd, all members of each, broken ones as
far as they go; compressed runs of URL escapes too). Of bytes that aren't text in UTF-8, the ASCII text in
them counts, as single bytes and as UTF-16; they are given up if they hold none. A layer knows the span of
the text that its characters came from: escapes are kept as numbers, what a run holds is one span. Layers
are taken from the worklist until none is left; one whose characters and spans were met before is not
taken again, so encodings that decode to themselves end.

What a run holds may be far larger than the run. It is never held whole: content of more than
`LAYER_CHARS` is read as a stream, in windows that overlap by `OVERLAP`, each a layer of the run's span. A
base64 run in it that is longer than the overlap is decoded as a stream of its own, from its beginning to
its end. Only compressed data that asks for a dictionary of over 256 MB (xz) or 128 MB (zstd) isn't
opened; the row says so in `oversize`.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from convene.llm.common import lean_batches

# The base patterns, in the order in which kinds are listed, and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Content over so many characters is read in windows of as many, which overlap by OVERLAP.
LAYER_CHARS, OVERLAP, STEP = 4 << 20, 1 << 18, 1 << 16
#: Memory that an xz stream's dictionary may take, and the window of a zstd frame.
XZ_MEMORY, ZSTD_WINDOW = 256 << 20, 1 << 27

# runs are possessive: a greedy group would remember every step
_URL = re.compile("(?:%[0-9A-Fa-f]{2})++")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})++")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile("(?:[A-Za-z0-9+/]{76}\r?\n(?=[A-Za-z0-9+/]))++[A-Za-z0-9+/]{1,76}={0,2}|(?:[A-Za-z0-9+/]{64}\r?\n(?=[A-Za-z0-9+/]))++[A-Za-z0-9+/]{1,64}={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile("[A-Za-z0-9+/_=-]+")
_PART = re.compile("[A-Za-z0-9]{16,}={0,2}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"
_OUTSIDE = re.compile("[^A-Za-z0-9+/_\\-\r\n]")


#: Runs of text in other bytes: shorter ones can't hold a match or an encoded one.
_ASCII = re.compile(rb"[\t\n\r -~]{12}")
_UTF16 = re.compile(rb"(?:[\t\n\r -~]\0){11}[\t\n\r -~]")


class Oversize(Exception):
    pass


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches in a text as it stands."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _format(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    if data[:3] == b"BZh":
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\0":
        return "xz"
    return "zstd" if data[:4] == b"\x28\xb5\x2f\xfd" else None


def _member(name: str):
    """(decompress(bytes, most), the object whose eof and unused_data tell of the end, bytes to feed at once)."""
    import zstandard

    if name == "zstd":  # knows no most, so a step is small: its blocks of 128 KiB take 4 bytes at least
        d = zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).decompressobj()
        return (lambda part, most: d.decompress(part)), d, 256
    d = zlib.decompressobj(31) if name == "gzip" else zlib.decompressobj() if name == "zlib" else bz2.BZ2Decompressor() if name == "bzip2" else lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=XZ_MEMORY)
    return d.decompress, d, STEP


class Source:
    """Bytes from an iterator of pieces, of which the first can be looked at."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held = iter(pieces), b""

    def look(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, None)) is not None:
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.look(n)
        self.held = self.held[n:]
        return out

    def back(self, data: bytes) -> None:
        self.held = data + self.held


class Inflated:
    """The content of compressed bytes, piece by piece: members of one format follow one another, zeros
    and zstd's skippable frames between them. `whole`: members read to their end."""

    def __init__(self, name: str, source: Source):
        self.name, self.source, self.whole, self.size = name, source, 0, 0

    def __iter__(self) -> Iterator[bytes]:
        import zstandard

        source = self.source
        try:
            while _format(source.look(8)) == self.name:
                decompress, d, step = _member(self.name)
                pending = b""  # taken in, but not yet given out by decoders with a most
                while not d.eof:
                    part = pending or source.take(step)
                    if not part and getattr(d, "needs_input", True):
                        return
                    got = decompress(part, LAYER_CHARS)
                    pending = getattr(d, "unconsumed_tail", b"")
                    self.size += len(got)
                    if got:
                        yield got
                self.whole += 1
                source.back(d.unused_data)
                while (head := source.look(8)) and (head[0] == 0 or head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):
                    left = 8 + int.from_bytes(head[4:8], "little") if head[0] else 1
                    while left > 0 and (skipped := source.take(min(left, STEP))):
                        left -= len(skipped)
        except (lzma.LZMAError, zstandard.ZstdError) as error:
            if re.search("memory usage limit|memory|window", str(error), re.I):
                raise Oversize from error
        except (zlib.error, OSError, EOFError, ValueError):
            pass


def _odd(text: str) -> int:
    """Characters that aren't printable."""
    return sum(text.count(c) for c in set(text) if not (c.isprintable() or c in "\t\n\r"))


def _text_or_bytes(data: bytes, names: list[str]) -> tuple[bool, list[tuple[str, str]]]:
    """Whether bytes are text, and (formats, text) of what they hold."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = ""
    if text and _odd(text) * 20 <= len(text):
        return True, [(">".join(names), text)]
    out = []
    at = {m.start() % 2 for m in _UTF16.finditer(data)}
    for k in sorted(at):  # of UTF-16BE, the low bytes begin at 1
        part = data[k:] + b"\0"
        out.append((">".join([*names, "utf-16"]), part[: len(part) & ~1].decode("utf-16-le", "replace")))
    if _ASCII.search(data):
        out.append((">".join([*names, "bytes"]), data.decode("latin-1")))
    return False, out


def _contents(pieces: Iterable[bytes], names: list[str]) -> Iterator[tuple[bool, str, str | Iterator[str]]]:
    """(whether it is sure that the bytes were meant as text or compressed text, formats, the text or a
    stream of it) of what bytes hold; compression may be nested."""
    source = Source(pieces)
    head = source.look(LAYER_CHARS + 1)
    name = _format(head)
    if name is not None:
        inner = Inflated(name, source if len(head) > LAYER_CHARS else Source([head]))
        met = False
        for sure, formats, text in _contents(inner, [*names, name]):
            met = True
            yield sure and inner.whole > 0, formats, text
        if met and inner.whole or len(head) > LAYER_CHARS:
            return  # else what looks like compressed data may be something else
    if len(head) <= LAYER_CHARS:
        sure, found = _text_or_bytes(head, names)
        for formats, text in found:
            yield sure, formats, text
        return
    # patterns and escapes are ASCII: in a stream, bytes are read as single characters, UTF-16 without its zeros
    yield True, ">".join([*names, "stream"]), (p.replace(b"\0", b"").decode("latin-1") for p in chain([source.take(len(head))], iter(lambda: source.take(STEP), b"")))


def _pieces(run: str) -> Iterator[bytes]:
    """The bytes of a base64 run, or nothing."""
    raw = run.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 != 1:
        try:
            yield base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
        except binascii.Error:
            pass


def _unbase64(pieces: Iterable[str]) -> Iterator[bytes]:
    """The bytes of a long base64 run in pieces of text."""
    held = ""
    for piece in pieces:
        held += piece.replace("\r", "").replace("\n", "").replace("-", "+").replace("_", "/")
        n = len(held) // 4 * 4
        yield base64.b64decode(held[:n])
        held = held[n:]
    if len(held) > 1:
        yield base64.b64decode(held + "=" * (4 - len(held)))


class Origin:
    """Where a layer's characters came from. Of a layer with escapes undone: the place, start and end of
    each escape's character, in the layer before; others follow the escape before them."""

    __slots__ = ("at", "starts", "ends", "before", "key")

    def __init__(self, before: Origin | None, at: array, starts: array, ends: array):
        self.at, self.starts, self.ends, self.before = at, starts, ends, before
        self.key = hash((at.tobytes(), starts.tobytes(), ends.tobytes(), before and before.key))

    def _of(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        if self.at[k] == i:
            return self.starts[k], self.ends[k]
        place = self.ends[k] + i - self.at[k] - 1
        return place, place + 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        # places go up with characters
        start, end = self._of(start)[0], self._of(end - 1)[1]
        return self.before.span(start, end) if self.before else (start, end)


class Whole:
    """All characters came from one span."""

    __slots__ = ("a", "b", "key")

    def __init__(self, a: int, b: int):
        self.a, self.b, self.key = a, b, hash((a, b))

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.a, self.b


class Layer:
    """A decoded text, where it came from (None: it is the first layer), and the path of decodings."""

    __slots__ = ("text", "origin", "path")

    def __init__(self, text: str, origin: Origin | Whole | None, path: str):
        self.text, self.origin, self.path = text, origin, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.origin.span(start, end) if self.origin else (start, end)

    def named(self, name: str) -> str:
        return f"{self.path}>{name}".strip(">")

    def rewritten(self, name: str, parts: Iterable[tuple[int, int, Iterator[tuple[str, int, int]]]]) -> Layer:
        """This layer with spans replaced: (start, end, characters with the start and end of their source)."""
        kind = "i" if len(self.text) < 1 << 31 else "q"
        at, starts, ends = array(kind), array(kind), array(kind)
        text, done, place = [], 0, 0
        for start, end, chars in parts:
            text.append(self.text[done:start])
            place += start - done
            run: list[str] = []
            for c, a, b in chars:
                run.append(c)
                if not isinstance(self.origin, Whole):
                    at.append(place)
                    starts.append(a)
                    ends.append(b)
                place += 1
                if len(run) == STEP:
                    text.append("".join(run))
                    run.clear()
            text.append("".join(run))
            done = end
        text.append(self.text[done:])
        origin = self.origin if isinstance(self.origin, Whole) else Origin(self.origin, at, starts, ends)
        return Layer("".join(text), origin, self.named(name))

    def inner(self, name: str, start: int, end: int, text: str | Iterator[str]) -> Iterator[Layer]:
        """What a run holds, as layers of its own; all of it came from the whole run."""
        whole, path = Whole(*self.span(start, end)), self.named(name)
        if isinstance(text, str):
            yield Layer(text, whole, path)
        else:
            yield from _windows(text, whole, path)


def _windows(pieces: Iterator[str], whole: Whole, path: str) -> Iterator[Layer]:
    """A stream in overlapping windows, and what its long base64 runs hold."""
    held = ""
    while True:
        while len(held) <= LAYER_CHARS and (more := next(pieces, None)) is not None:
            held += more
        if len(held) <= LAYER_CHARS:
            yield Layer(held, whole, path)
            return
        window = held[:LAYER_CHARS]
        yield Layer(window, whole, path)
        run = len(window.rstrip(_ALPHABET))
        if LAYER_CHARS - run <= OVERLAP:
            held = held[LAYER_CHARS - OVERLAP :]
            continue
        rest: list[str] = []  # the run's last characters, and what follows it
        mine = Layer("", whole, path)

        def running(tail: str) -> Iterator[str]:
            """The run from its beginning; its windows are layers too."""
            yield window[run:]
            while True:
                m = _OUTSIDE.search(tail)
                if m:
                    yield tail[: m.start()]
                    rest.append(tail)
                    return
                yield tail
                beyond.append(tail)
                tail = next(pieces, None)
                if tail is None:
                    rest.append("")
                    return

        beyond: list[str] = []
        stream = running(held[LAYER_CHARS:])
        last = window[-OVERLAP:]
        for _, formats, text in _contents(_unbase64(stream), ["base64"]):
            for layer in mine.inner(formats, 0, 1, text):
                yield layer
                while len(beyond) * STEP > LAYER_CHARS:  # the run's own text goes on
                    more = "".join(beyond)
                    beyond.clear()
                    yield Layer(last + more, whole, path)
                    last = more[-OVERLAP:]
        for _ in stream:  # what the reader left
            pass
        held = last + "".join(beyond) + "".join(rest)


def _url_chars(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    data = bytes.fromhex(run.replace("%", ""))
    i = 0
    while i < len(data):
        n = 1 if data[i] < 128 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4 if data[i] >> 3 == 30 else 1
        try:
            c = data[i : i + n].decode("utf-8")
        except UnicodeDecodeError:
            n, c = 1, chr(data[i])
        yield c, at + 3 * i, at + 3 * (i + n)
        i += n


def _unicode_chars(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    held: tuple[int, int, int] | None = None  # a high surrogate: code, start, end
    for m in _ESCAPE.finditer(run):
        code = int(m[m.lastindex], 16)
        if held and 0xDC00 <= code <= 0xDFFF:
            yield chr(0x10000 + (held[0] - 0xD800 << 10) + code - 0xDC00), held[1], at + m.end()
            held = None
            continue
        if held:
            yield chr(held[0]), held[1], held[2]
            held = None
        if 0xD800 <= code <= 0xDBFF:
            held = code, at + m.start(), at + m.end()
        else:
            yield chr(code) if code < 0x110000 else "\ufffd", at + m.start(), at + m.end()
    if held:
        yield chr(held[0]), held[1], held[2]


def layers_of(layer: Layer, oversize: list[bool]) -> Iterator[Layer]:
    """The layers that one step of decoding makes of a layer. oversize gets an item for each that would
    take too large a dictionary."""
    text = layer.text

    def held(name: str, start: int, end: int, pieces: Iterable[bytes], skip: tuple[str, ...] = ()) -> Iterator[Layer | bool]:
        try:
            for sure, formats, inside in _contents(pieces, []):
                if sure:
                    yield True
                if formats not in skip:
                    yield from layer.inner(f"{name}>{formats}", start, end, inside)
        except Oversize:
            oversize.append(True)

    if "%" in text:
        if _URL.search(text):
            yield layer.rewritten("url", ((m.start(), m.end(), _url_chars(m[0], m.start())) for m in _URL.finditer(text)))
        for m in _URL.finditer(text):
            if m.end() - m.start() >= 24:  # what is text as it stands is in the layer above
                yield from (x for x in held("url", m.start(), m.end(), [bytes.fromhex(m[0].replace("%", ""))], ("", "bytes")) if x is not True)
    if "\\" in text and _UNICODE.search(text):
        yield layer.rewritten("unicode", ((m.start(), m.end(), _unicode_chars(m[0], m.start())) for m in _UNICODE.finditer(text)))
    runs = [(m.start(), m.end()) for m in _BASE64.finditer(text)]
    for run in [*runs, *sorted(set(_wrapped(text)) - set(runs))]:
        spans, tried = [run], False
        while spans:
            start, end = spans.pop()
            sure = False
            for x in held("base64", start, end, _pieces(text[start:end])):
                if x is True:
                    sure = True
                else:
                    yield x
            if not sure and not tried:  # the alphabet's signs may as well be what parts the run from its neighbours
                tried = True
                spans = [(start + p.start(), start + p.end()) for p in _PART.finditer(text[start:end]) if p.end() - p.start() < end - start]


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Spans of lines of one width, and the shorter one that ends them, in base64's alphabet."""
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        rows = [(m.start() + r.start(), m.start() + r.end()) for r in _LINE.finditer(m[0])]
        i = 0
        while i < len(rows) - 1:
            j, width = i + 1, rows[i][1] - rows[i][0]
            while j < len(rows) and rows[j][1] - rows[j][0] == width:
                j += 1
            last = j if j < len(rows) and rows[j][1] - rows[j][0] < width else j - 1
            if last > i and rows[last][1] - rows[i][0] >= 16:
                yield rows[i][0], rows[last][1]
            i = j


def scan_text(text: str) -> tuple[list[tuple[str, int, int, str]], bool]:
    """All (kind, start, end, path of decodings) in a text, path empty for what stands in it as it is,
    and whether compressed data asked for too large a dictionary. One span found on several paths keeps
    the shortest, of these the first by name."""
    found = {(k, a, b): "" for k, a, b in base_spans(text)}
    seen, oversize = {hash((text, None))}, []
    work = [layers_of(Layer(text, None, ""), oversize)]  # layers that are still to come, innermost last
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        mark = hash((new.text, new.origin.key))
        if mark in seen:
            continue
        seen.add(mark)
        for kind, a, b in base_spans(new.text):
            key = (kind, *new.span(a, b))
            if key not in found or (len(found[key]), found[key]) > (len(new.path), new.path):
                found[key] = new.path
        work.append(layers_of(new, oversize))
    return sorted(((k, a, b, p) for (k, a, b), p in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2])), bool(oversize)


SPAN = "array<struct<kind:string,start:long,end:long,path:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, path of decodings) and oversize for every row of
    docs (doc_id, text). Texts of any length are scanned whole. A null text has no span; repeated rows
    get repeated results, an empty table none; other columns are ignored."""
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(struct)), ("oversize", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                got = [scan_text(t or "") for t in batch.column("text").to_pylist()]
                spans = [[dict(zip(("kind", "start", "end", "path"), s)) for s in g[0]] for g in got]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, pa.list_(struct)), pa.array([g[1] for g in got])], schema=schema)

    return lean_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPAN}, oversize boolean")
