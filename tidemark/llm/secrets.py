"""Secret scan with a recursive decoding worklist.

The text itself is the first layer.  A layer is scanned with all patterns, then what is encoded in it is unwrapped into
layers of their own, and so on until nothing new comes out.  There are two kinds of unwrapping.

URL and Unicode escapes are undone in place, all levels at once: an escape made of escapes (``%2541``) is rewritten until none
is left, by a stack that sees each character once.  No pattern holds a ``%`` or a backslash, so what stands in a level in
between stands in the last one too.  Two arrays map the characters of that layer to those of the text.

A base64 run (one line, or lines of equal length as mail wraps them) stands for one place, the run.  It is decoded from each of
its first four characters, since a path may stand before it; bytes are scanned as they are and without zero bytes (UTF-16).
Compressed streams anywhere inside are inflated once, level by level and member by member, and read in windows, so that neither
depth nor number costs more than the layers themselves, and the memory does not grow with what they hold.  A layer that was seen before in the same run is not unwrapped again, so cycles end; equal
runs at other places are reported there.

The operator is a map over rows: no shuffle, memory for one slice of texts.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

BASE = ("assign", "access", "hex")
#: Kinds that only the method has: well-known key formats, and the base kinds inside decoded layers.
EXTRA = ("pem", "github", "slack", "jwt")
#: A compressed run that holds more than the limit a caller gave: only what is inside the limit was scanned.
OVERSIZE = "oversize"
ORDER = {kind: i for i, kind in enumerate([*BASE, *EXTRA, *(f"layer_{k}" for k in (*BASE, *EXTRA)), OVERSIZE])}

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_GITHUB = re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.A)
_SLACK = re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A)
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A)

_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: All that an escape, or an escape made of escapes, can consist of.
_ZONE = re.compile(r"[%\\][%\\ux0-9A-Fa-f]{2,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_BLANKS = re.compile(rb"\x20{3,}")
_TAIL = re.compile(rb"[A-Za-z0-9+/_.=%\\-]*\Z")
#: Inflated bytes are read in windows; a token that a window cuts is read again with the next, up to so many bytes.
WINDOW, CARRY = 8 << 20, 1 << 20
#: Compressed streams are read, and put out, in pieces of at most so many bytes.
_PIECE = 1 << 20


_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True


def _has_run(text: str) -> bool:
    """Whether sixteen characters of base64 follow each other, without which there is no hexadecimal or base64 run."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.flatnonzero(~_RUN_BYTE[np.minimum(codes, 255)] | (codes > 255))
    return bool(np.diff(places, prepend=-1, append=len(codes)).max(initial=0) > 16)


def scan(text: str, runs: bool = True) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of every secret that stands in the text as it is; runs tells whether it may have long ones."""
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        yield from (("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        yield from (("access", *m.span()) for m in _ACCESS.finditer(text))
    if runs:
        yield from (("hex", *m.span()) for m in _HEX.finditer(text))
    for kind, hint, pattern in (("pem", "-----BEGIN", _PEM), ("github", "gh", _GITHUB), ("slack", "xox", _SLACK), ("jwt", "eyJ", _JWT)):
        if hint in text:
            yield from ((kind, *m.span()) for m in pattern.finditer(text))


def _hex(c: int) -> bool:
    return 48 <= c <= 57 or 65 <= c <= 70 or 97 <= c <= 102


def _undo(zone: str, at: int) -> tuple[list[int], list[int], list[int]]:
    """The code points that a zone stands for when no escape is left, and the start and end of what each stands for.

    Code points from 0x110080 on are raw bytes of ``%`` escapes until the end, when those that form UTF-8 become characters.
    """
    raw = 0x110000
    codes, starts, ends = [], [], []
    for i, c in enumerate(map(ord, zone), at):
        codes.append(c)
        starts.append(i)
        ends.append(i + 1)
        while _hex(codes[-1]) and len(codes) > 2 and _hex(codes[-2]):
            mark = codes[-3]
            if mark == 37:  # %
                n, value = 3, int(chr(codes[-2]) + chr(codes[-1]), 16)
                value += raw if value >= 128 else 0
            elif len(codes) > 3 and mark == 120 and codes[-4] == 92:  # \x
                n, value = 4, int(chr(codes[-2]) + chr(codes[-1]), 16)
            elif len(codes) > 5 and codes[-6] == 92 and codes[-5] == 117 and _hex(codes[-4]) and _hex(codes[-3]):  # \u
                n, value = 6, int("".join(map(chr, codes[-4:])), 16)
                if 0xDC00 <= value < 0xE000 and len(codes) > 6 and 0xD800 <= codes[-7] < 0xDC00:
                    n, value = 7, 0x10000 + ((codes[-7] - 0xD800) << 10) + value - 0xDC00
            else:
                break
            end = ends[-1]
            del codes[1 - n + len(codes) :], starts[1 - n + len(starts) :], ends[1 - n + len(ends) :]
            codes[-1], ends[-1] = value, end
    if not any(c >= raw for c in codes):
        return codes, starts, ends
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    i = 0
    while i < len(codes):
        n, value = 1, codes[i] - raw if codes[i] >= raw else codes[i]
        if codes[i] >= raw + 0xC2:
            size = 2 if value < 0xE0 else 3 if value < 0xF0 else 4
            body = bytes(c - raw for c in codes[i : i + size] if c >= raw)
            try:
                n, value = size, ord(body.decode("utf-8"))
            except (UnicodeDecodeError, TypeError):
                n = 1
        for column, x in zip(out, (value, starts[i], ends[i + n - 1]), strict=True):
            column.append(x)
        i += n
    return out


def unescaped(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with all levels of URL and Unicode escapes undone, and the start and end of what each character stands for."""
    if not _ESCAPE.search(text):
        return None
    pieces, starts, ends, done = [], [], [], 0
    for m in _ZONE.finditer(text):
        codes, a, b = _undo(m[0], m.start())
        pieces += [text[done : m.start()], "".join(map(chr, codes))]
        plain = np.arange(done, m.start(), dtype=np.int32)
        starts += [plain, np.array(a, np.int32)]
        ends += [plain + np.int32(1), np.array(b, np.int32)]
        done = m.end()
    rest = np.arange(done, len(text), dtype=np.int32)
    return "".join([*pieces, text[done:]]), np.concatenate([*starts, rest]), np.concatenate([*ends, rest + np.int32(1)])


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


class _Level:
    """One level of compression of a nest.

    ``start``: not known yet whether a stream begins (``held``: too few bytes to tell); ``stream``: one is being read (``held``: what
    it took without giving anything, which is content if it breaks; ``more``: it can give more without being fed); ``plain``: what comes is content; ``dead``: a
    stream broke, nothing follows.
    """

    __slots__ = ("state", "unpack", "held", "given", "more")

    def __init__(self) -> None:
        self.state, self.unpack, self.held, self.given, self.more = "start", None, b"", False, False


def _give(unpack, fed: bytes) -> tuple[bytes, int, bool]:
    """What a stream gives, a piece at most; how many bytes of the fed ones it left; whether it has more."""
    piece = unpack.decompress(fed, _PIECE)
    if unpack.eof:
        return piece, len(unpack.unused_data), False
    if isinstance(unpack, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        return piece, 0, not unpack.needs_input
    left = len(unpack.unconsumed_tail)
    return piece, left, not left and len(piece) == _PIECE


class _Unwrapped:
    """What the compressed stream at a place of some bytes holds when no level of compression is left, in pieces.

    Levels are a list and pieces wait on a stack, so that a nest of any depth takes the time of its layers and, as a stream
    that ended is forgotten, little memory.  Streams that follow each other make one content.  ``end`` is where the last whole
    stream ends in the bytes.
    """

    def __init__(self, raw: bytes, at: int) -> None:
        self.end, self.levels, self.todo = at, [_Level()], [(0, raw, at)]

    def __iter__(self) -> Iterator[bytes]:
        while self.todo:
            yield from self._step(*self.todo.pop())
        for level in self.levels[1:]:  # what was too short, or gave nothing, was no stream
            if level.held and level.state in ("start", "stream"):
                yield level.held

    def _step(self, i: int, data: bytes, at: int) -> Iterator[bytes]:
        if i == len(self.levels):
            self.levels.append(_Level())
        level, out, size, step = self.levels[i], [], 0, 512
        while size < _PIECE and (at < len(data) or level.more) and level.state in ("start", "stream"):
            if level.state == "start":
                head = level.held + data[at : at + 10]
                if len(head) < 10:  # no stream that holds anything is shorter
                    level.held, at = head, len(data)
                    break
                if level.held:  # it began in the piece before
                    data, at, level.held = level.held + data[at:], 0, b""
                level.unpack = _decompressor(head) if _STREAM.match(head) else None
                level.state, level.given, step = "stream" if level.unpack else "plain", False, 512
                continue
            fed = b"" if level.more else data[at : at + step]
            step = min(step * 4, _PIECE)
            try:
                piece, left, level.more = _give(level.unpack, fed)
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                level.state, level.unpack, level.more = "dead" if level.given else "plain", None, False
                data, at, level.held = level.held + data[at:], 0, b""
                break
            at += len(fed) - left
            if piece:
                out.append(piece)
                size += len(piece)
                level.given, level.held = True, b""
            elif not level.given:
                level.held += fed[: len(fed) - left]
            if level.unpack.eof:
                level.state, level.unpack, level.held = "start", None, b""
                if i == 0:
                    self.end = at
        if level.state in ("start", "stream") and (at < len(data) or level.more):
            self.todo.append((i, data, at))
        if out:
            self.todo.append((i + 1, b"".join(out), 0))
        if level.state == "plain" and i:  # the first level's own bytes were read before
            for k in range(at, len(data), _PIECE):
                yield data[k : k + _PIECE]


def _layers(raw: bytes, limit: int | None) -> Iterator[bytes | None]:
    """What all compressed streams in some bytes hold, in windows; what whole streams took is not tried again."""
    done = 0
    for m in _STREAM.finditer(raw):
        if m.start() >= done:
            inner = _Unwrapped(raw, m.start())
            yield from _windows(iter(inner), limit)
            done = inner.end


def _windows(stream: Iterator[bytes], limit: int | None) -> Iterator[bytes | None]:
    """A stream as layers to scan, each with the end of the one before; None where a limit ends it."""
    held, size = b"", 0
    for piece in stream:
        size += len(piece)
        if limit is not None and size > limit:
            yield held + piece[: len(piece) - (size - limit)]
            yield None
            return
        held += _BLANKS.sub(b"  ", piece)
        if len(held) >= WINDOW:
            yield held
            held = held[max(_TAIL.search(held[-CARRY:]).start() + max(0, len(held) - CARRY) - 64, 0) :]
    if held:
        yield held


def _runs(text: str) -> Iterator[tuple[int, int, bytes, tuple[int, ...]]]:
    """Start, end and characters of each base64 run, and where in them the lines of a wrapped one end."""
    for m in _BASE64.finditer(text):
        yield *m.span(), m[0].rstrip("=").encode(), ()
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines, at = [], m.start()
        for line in m[0].split("\n"):
            body = line.strip("\r\x20\t")
            first = at + line.index(body)
            # lines of one length, the last at most that long
            if lines and (len(lines[-1][1]) != len(lines[0][1]) or len(body.rstrip("=")) > len(lines[0][1])):
                yield from _joined(lines)
                lines = []
            lines.append((first, body))
            at += len(line) + 1
        yield from _joined(lines)


def _joined(lines: list[tuple[int, str]]) -> Iterator[tuple[int, int, bytes, tuple[int, ...]]]:
    if len(lines) > 1:
        seams = np.cumsum([len(b) for _, b in lines])[:-1].tolist()
        yield lines[0][0], lines[-1][0] + len(lines[-1][1]), "".join(b for _, b in lines).rstrip("=").encode(), tuple(seams)


def _decoded(run: bytes) -> Iterator[tuple[int, bytes]]:
    """The bytes of a base64 run from each of its first four characters on, with that number."""
    run = run.translate(bytes.maketrans(b"-_", b"+/"))
    for skip in range(min(4, len(run) - 1)):
        body = run[skip:]
        body = body[:-1] if len(body) % 4 == 1 else body
        yield skip, base64.b64decode(body + b"=" * (-len(body) % 4))


def _views(raw: bytes) -> Iterator[str]:
    """The bytes as characters, and without zero bytes, which gives the ASCII of UTF-16 and UTF-32."""
    yield raw.decode("latin-1")
    if b"\0" in raw:
        yield raw.replace(b"\0", b"").decode("latin-1")


def _inside(run: bytes, seams: tuple[int, ...], limit: int | None) -> set[str]:
    """The kinds in all layers inside a base64 run; of a wrapped run those that its single lines cannot show.

    The worklist holds what is still to be unwrapped of each layer above the one at hand, so that layers are made when
    their turn comes, and a nest of any depth is a loop.
    """
    kinds: set[str] = set()
    seen: set[int] = set()
    todo: list[Iterator[bytes | None]] = []

    def below(raw: bytes, texts: set[str]) -> Iterator[bytes | None]:
        for text in texts:
            for _, _, inner, _ in _runs(text):
                yield from (deeper for _, deeper in _decoded(inner))
        yield from _layers(raw, limit)

    def read(raw: bytes, place=None) -> None:
        texts = set()
        for view in _views(raw):
            runs = _has_run(view)
            kinds.update("layer_" + k for k, a, b in scan(view, runs) if place is None or len(view) != len(raw) or place(a, b))
            texts |= {view} if runs else set()
            flat = unescaped(view)
            if flat is not None and (runs := _has_run(flat[0])):
                texts.add(flat[0])
            if flat is not None:
                kinds.update("layer_" + k for k, _, _ in scan(flat[0], runs))
        todo.append(below(raw, texts))

    for skip, raw in _decoded(run):
        seen.add(hash(raw))
        read(raw, (lambda a, b, skip=skip: any(skip + 4 * (a // 3) < s < skip + 4 * (-(-b // 3)) for s in seams)) if seams else None)
        while todo:
            layer = next(todo[-1], False)
            if layer is False:
                todo.pop()
            elif layer is None:
                kinds.add(OVERSIZE)
            elif layer and hash(layer) not in seen:
                seen.add(hash(layer))
                read(layer)
    return kinds


def find_all(text: str, limit: int | None = None) -> list[tuple[str, int, int]]:
    """Kind, start and end of all secrets, by start, kind as listed and end; those of decoded layers have a prefix."""
    found, known = set(scan(text)), {}
    flat = unescaped(text)
    layers = [(text, None, None)] if flat is None else [(text, None, None), flat]
    for layer, starts, ends in layers:
        span = (lambda a, b: (a, b)) if starts is None else lambda a, b, s=starts, e=ends: (int(s[a]), int(e[b - 1]))
        if starts is not None:
            found.update(("layer_" + kind, *span(a, b)) for kind, a, b in scan(layer) if (kind, *span(a, b)) not in found)
        for a, b, run, seams in _runs(layer):
            if (run, seams) not in known:
                known[run, seams] = _inside(run, seams, limit)
            found.update((kind, *span(a, b)) for kind in known[run, seams])
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


_FINDINGS = "array<struct<kind:string,start:int,end:int,value:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def find_secrets(docs: DataFrame, *, max_inflated: int | None = None) -> DataFrame:
    """``doc_id, secrets`` of columns ``doc_id, text``: an array of (kind, start, end, value), a row for each input row.

    Offsets count code points of the text, end exclusive; ``value`` is the text there (still encoded for kinds ``layer_*``).
    Null and empty texts have none; equal rows have equal findings, and other columns, whatever their names, are not looked at.
    Texts are read whole, and so is what they hold: very long texts, runs and nests take time in proportion to the sum of their layers.  Who fears decompression bombs may bound what one
    compressed stream is read to with ``max_inflated`` bytes; a run that holds more then has the kind ``oversize``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find_all(t, max_inflated)] if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _ARROW)], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, secrets {_FINDINGS}")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans, and all spans."""
    count = lambda name: F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return find_secrets(docs).select("doc_id", *map(count, BASE), F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"))
