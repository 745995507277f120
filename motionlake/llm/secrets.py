"""Secret scans with a recursive decoding worklist.

Every whole text is scanned, then each layer found in it: URL escapes, Unicode
escapes, base64 and compressed bytes are unwrapped until nothing new appears.
Escapes are decoded in the whole text at once, so a find may be escaped in part.
A layer already seen at the same place is not opened again, nor is one within
itself, so cycles end.  Compressed bytes are inflated and scanned in pieces.
Each character of a layer knows the span of the original text that it came
from; a find in a layer is reported at that span.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: A run's leftmost match takes the whole run, so the length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Stretches that may hold a stream in URL or Unicode escapes.
_URL = re.compile(r"[A-Za-z0-9._~+/=&:@!$*,;%-]++")
_UNICODE = re.compile(r"[!-~]++")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over line breaks, as in MIME and PEM.
_BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\t ]*[A-Za-z0-9+/_-]++)++={0,2}")
#: Escapes, and escapes of escapes: as no find holds a percent sign or a backslash, what is between the layers needs no scan.
_ESCAPE = re.compile(r"\\(?:u005[cC]|x5[cC])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
_HEXES = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00", re.DOTALL)
#: No find and no layer that holds one is shorter, and all are ASCII.
_RUN = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
#: Bytes that are inflated at once, that make a piece, that pieces share at least, and that a piece without a space may have.
CHUNK, PIECE, TAIL, MOST_PIECE = 1 << 20, 1 << 24, 1 << 16, 1 << 26
#: Bytes that one document's compressed layers may unfold to together: a guard against decompression bombs.
#: Each stream that it leaves unread input of, or that is cut within a run of MOST_PIECE, counts in layers_left.
MOST_UNPACKED = 1 << 30


def finds(text: str) -> Iterator[tuple[str, int, int]]:
    """Base finds: kind, start, end."""
    if _WORDS.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield "assign", m.start(), m.end()
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _opened(chunks: Iterator[bytes], room: list[int], above: tuple[bytes, ...] = ()) -> Iterator[bytes]:
    """A stream as it is or, if it is compressed, inflated, as deep as it goes, member after member, then what follows them.

    ``room``: bytes left, streams left unread.  A stream that begins like one
    that it came out of is a cycle and isn't opened again.
    """
    chunks, head = iter(chunks), b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 16:
            break
    if not _MAGIC.match(head):
        if head:
            yield head
        yield from chunks
        return
    mine = hashlib.blake2b(head, digest_size=16).digest()
    if mine in above:
        return
    follows: list[bytes] = []

    def inflated() -> Iterator[bytes]:
        inflate = {0x1F: lambda: zlib.decompressobj(31), 0x78: zlib.decompressobj, 0x42: bz2.BZ2Decompressor, 0xFD: lzma.LZMADecompressor}[head[0]]()
        data = head
        while not inflate.eof:
            if room[0] <= 0:
                room[1] += 1
                return
            try:
                chunk = inflate.decompress(data, min(CHUNK, room[0]))
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            data = getattr(inflate, "unconsumed_tail", b"")
            if chunk:
                room[0] -= len(chunk)
                yield chunk
            elif not data and not inflate.eof:
                data = next(chunks, b"")
                if not data:
                    return
        follows.append(inflate.unused_data)

    yield from _opened(inflated(), room, (*above, mine))
    if follows:
        yield from _opened(chain([follows[0].lstrip(b"\0")], chunks), room, above)


def _pieces(chunks: Iterator[bytes], room: list[int]) -> Iterator[str]:
    """Texts of a stream; whatever a piece's end may cut is whole in the next, as neither finds nor layers hold many spaces."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        if len(held) >= PIECE:
            at = held.rfind(b" ", 0, len(held) - TAIL)
            if at < len(held) // 2:
                if len(held) < MOST_PIECE:
                    continue
                room[1] += 1
                at = len(held) - TAIL
            text = _text(bytes(held))
            if text:
                yield text
            del held[:at]
    text = _text(bytes(held))
    if text:
        yield text


def _text(data: bytes) -> str | None:
    """Bytes as text, as Latin-1 if they aren't UTF-8; None if nothing in them can be found."""
    if not _RUN.search(data):
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _streams(data: bytes, room: list[int], start: int, end: int) -> Iterator[tuple[str, None, int, int]]:
    """Layers that compressed streams within ``data`` hold; all their characters stand for the whole region."""
    for magic in _MAGIC.finditer(data):
        for decoded in _pieces(_opened([data[magic.start() :]], room), room):
            yield decoded, None, start, end


def _layers(text: str, room: list[int]) -> Iterator[tuple[str, list[int] | None, int, int]]:
    """Decoded layer, start in ``text`` of each of its characters plus the end (None: all stand for the whole region), region."""
    if "%" in text and _PERCENT.search(text):
        for m in _URL.finditer(text):
            if _PERCENT.search(text, m.start(), m.end()):
                yield from _streams(unquote_to_bytes(m[0]), room, m.start(), m.end())
        out, at, end = [], array("q"), 0
        for run in _PERCENT.finditer(text):
            out.append(text[end : run.start()])
            at.extend(range(end, run.start()))
            escapes = list(_HEXES.finditer(text, run.start(), run.end()))
            piece = bytes(int(e[1], 16) for e in escapes).decode("utf-8", "replace")
            width = 0
            for c in piece:
                at.append(escapes[min(width, len(escapes) - 1)].start())
                width += len(c.encode()) if c != "\ufffd" else 1
            out.append(piece)
            end = run.end()
        out.append(text[end:])
        at.extend(range(end, len(text) + 1))
        yield "".join(out), at, 0, len(text)
    if ("\\u" in text or "\\x" in text) and _ESCAPE.search(text):
        for m in _UNICODE.finditer(text):
            if _ESCAPE.search(text, m.start(), m.end()):
                plain = _ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)), m[0])
                yield from _streams(plain.encode("latin-1", "ignore"), room, m.start(), m.end())
        out, at, end = [], array("q"), 0
        for e in _ESCAPE.finditer(text):
            out.append(text[end : e.start()])
            at.extend(range(end, e.start()))
            out.append(chr(int(e[1] or e[2], 16)))
            at.append(e.start())
            end = e.end()
        out.append(text[end:])
        at.extend(range(end, len(text) + 1))
        decoded = "".join(out)
        if any("\ud800" <= c <= "\udfff" for c in decoded):
            decoded = "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in decoded)
        yield decoded, at, 0, len(text)
    for pattern in (_BASE64, _BLOCK):
        for m in pattern.finditer(text):
            start, end = m.span()
            # positions of the characters that count
            body = range(start, end) if pattern is _BASE64 else array("q", (i for i in range(start, end) if text[i] not in "\r\n\t "))
            plain = (m[0] if pattern is _BASE64 else "".join(m[0].split())).rstrip("=").replace("-", "+").replace("_", "/")
            for cut in range(4):  # a run may begin with letters that aren't part of it
                piece = plain[cut:]
                piece = piece[: len(piece) - (len(piece) % 4 == 1)]
                try:
                    data = base64.b64decode(piece + "=" * (-len(piece) % 4))
                except (binascii.Error, ValueError):
                    continue
                yield from _streams(data, room, start, end)
                decoded = _text(data)
                if not decoded:
                    continue
                if decoded.isascii() or len(decoded) < len(data):
                    at, width = array("q"), 0
                    for c in decoded:
                        at.append(body[cut + width * 4 // 3])
                        width += len(c.encode())
                    at.append(end)
                    yield decoded, at, start, end
                    continue
                for run in _RUN.finditer(data):  # bytes that aren't text: what may hold a find
                    at = array("q", (body[cut + i * 4 // 3] for i in range(run.start(), run.end())))
                    stop = body[cut + (run.end() * 8 - 1) // 6] + 1
                    at.append(stop)
                    yield run[0].decode("ascii"), at, at[0], stop


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans and all spans, each (start, number of the kind, end) in order, and how many streams the guard left unread."""
    base = sorted((s, KINDS.index(k), e) for k, s, e in finds(text or ""))
    spans = set(base)
    seen: set[bytes] = set()
    room = [MOST_UNPACKED, 0]

    def digest(layer: str) -> bytes:
        return hashlib.blake2b(layer.encode("utf-8", "replace"), digest_size=16).digest()

    # depth first, so that one piece of a stream is held at a time
    work = [(_layers(text or "", room), None, -1, -1, (digest(text or ""),))]
    while work:
        layers, at, first, last, above = work[-1]
        found = next(layers, None)
        if found is None:
            work.pop()
            continue
        inner, own, start, end = found
        # positions in the original text
        if first < 0:
            low, high = start, end
        elif at is None:
            low, high = first, last
        else:
            low, high = at[start], at[end]
        mine = digest(inner)
        key = f"{low}:{high}:".encode() + mine
        if key in seen or mine in above:
            continue
        seen.add(key)
        if first < 0:
            place = own
        else:
            place = None if own is None or at is None else array("q", (at[i] for i in own))
        for kind, s, e in finds(inner):
            spans.add((low, KINDS.index(kind), high) if place is None else (place[s], KINDS.index(kind), max(place[e], place[s] + 1)))
        work.append((_layers(inner, room), place, low, high, (*above, mine)))
    return base, sorted(spans), room[1]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers_left for each row of ``docs``; a null text is empty, and repeated rows are scanned each."""

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers_left"]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, spans, left = scan(text.as_py())
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), left))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers_left long"
    )
