"""Operator 10, secret scans: recursive decoding worklist.

The text is layer 0.  Every layer is scanned for secrets and for encoded
stretches (URL escapes, Unicode and byte escapes, base64, gzip, zlib and
zstandard data, UTF-16); each decoded stretch is a new layer on the
worklist, until no new layer appears.  Compressed data is looked for in
every layer, read over all its members or frames to its end, and scanned
in pieces (``PIECE``).  A layer whose bytes were seen already for
the same stretch is not followed again (cycles).  Findings in a decoded
layer are mapped back to code points of the original text: character by
character through escapes, to the whole encoded stretch through base64
and compression.  Base64 is read at its four alignments, line by line and
over line ends; decoded bytes need not be text.

Defined results: NULL is an empty text; an empty text has no findings;
repeated rows get one row each; spans that several layers find are
listed once; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")

# bytes patterns: white space and letters are ASCII only, as asked for
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

URL = re.compile(rb"(?:%[0-9A-Fa-f]{2})")
UNICODE = re.compile(rb"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines.
WRAPPED = re.compile(rb"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\t ]*[A-Za-z0-9+/_-]+)+={0,2}")

#: Escapes that may stand for bytes, in texts that have one above 0x7F.
BYTES = re.compile(UNICODE.pattern + rb"|\\[abfnrtv0'\"\\/]")
HIGH = re.compile(rb"\\(?:x|u00)[89A-Fa-f][0-9A-Fa-f]|&#(?:[xX]0*[89A-Fa-f][0-9A-Fa-f]|0*(?:12[89]|1[3-9][0-9]|2[0-9]{2}));")
SHORT = dict(zip(b"abfnrtv0", b"\a\b\f\n\r\t\v\0"))
UTF16 = re.compile(rb"(?:[\t\n\r -~]\0){6,}|(?:\0[\t\n\r -~]){6,}")

MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")
#: Decompressed data is scanned in pieces of about so many bytes.  A piece ends behind a byte that no
#: encoded stretch has, and grows up to MOST_PIECES pieces to get there; the next one repeats OVERLAP.
PIECE, MOST_PIECES, OVERLAP = 8 << 20, 8, 1 << 20
#: Bytes of escapes, of base64 and between its lines.
ENCODED = re.compile(rb"[^A-Za-z0-9+/_=%\\&#;\s\0-]")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                    ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                    ("n_layers", pa.int64())])


def find(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of one layer, in bytes."""
    out = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return out


def utf8_of(m: bytes) -> bytes:
    """The character of a Unicode escape."""
    if m[:1] == b"\\":
        code = int(m[2:], 16)
    else:
        code = int(m[3:-1], 16) if m[2:3] in b"xX" else int(m[2:-1])
    return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else m


def byte_of(m: bytes) -> bytes:
    """The byte of an escape, or the character of one above 0xFF."""
    if m[:1] == b"\\" and m[1:2] not in b"ux":
        return bytes((SHORT.get(m[1], m[1]),))
    code = int(m[2:], 16) if m[:1] == b"\\" else int(m[3:-1], 16) if m[2:3] in b"xX" else int(m[2:-1])
    return bytes((code,)) if code < 256 else utf8_of(m)


def unescape(data: bytes, pattern: re.Pattern, decode, placed: bool = True):
    """The text with its escapes resolved, and for each of its bytes (``placed``) the source bytes it stands for."""
    if not placed:
        plain, n = pattern.subn(lambda m: decode(m[0]), data)
        return (plain, None, None) if n else None
    parts, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(data):
        a, b = m.span()
        plain = decode(m[0])
        parts += [data[last:a], plain]
        starts += [np.arange(last, a), np.full(len(plain), a)]
        ends += [np.arange(last + 1, a + 1), np.full(len(plain), b)]
        last = b
    if not parts:
        return None
    parts.append(data[last:])
    starts.append(np.arange(last, len(data)))
    ends.append(np.arange(last + 1, len(data) + 1))
    return b"".join(parts), np.concatenate(starts), np.concatenate(ends)


def inflate(data: bytes, at: int, used: list[tuple[int, int]]):
    """Content of the gzip, zlib or zstandard data at ``at``, part by part over all members or frames.

    Ends where the data ends or is damaged; the last of ``used`` is the
    place to go on from and the end of the data.
    """
    kind, view = data[at:at + 2], memoryview(data)
    zstd = kind == b"\x28\xb5"
    step = 512 if zstd else 1 << 16  # a zstd object has no limit of its output
    while data[at:at + 2] == kind and MAGIC.match(data, at):
        one = zstandard.ZstdDecompressor().decompressobj() if zstd else zlib.decompressobj(47)
        try:
            for a in range(at, len(data), step):
                rest = view[a:a + step]
                end = a + len(rest)
                if zstd:
                    yield one.decompress(rest)
                else:
                    while True:
                        out = one.decompress(rest, PIECE)
                        yield out
                        rest = one.unconsumed_tail
                        if one.eof or not rest and len(out) < PIECE:
                            break
                if one.eof:
                    break
        except (zlib.error, zstandard.ZstdError):
            used.append((max(at, used[-1][0]) if used else at + 2, len(data)))
            return
        if not one.eof:
            used.append((len(data), len(data)))
            return
        at = end - len(one.unused_data)
        used.append((at, at))


def pieces(parts):
    """Overlapping pieces of a stream."""
    held, size, old, tried = [], 0, 0, 0  # old: bytes of the overlap; tried: size at the last look for an end
    for p in parts:
        held.append(p)
        size += len(p)
        if size < PIECE + max(old, tried):
            continue
        data = b"".join(held)
        m = ENCODED.search(data[:-OVERLAP - 1:-1])
        if not m and size < MOST_PIECES * PIECE:
            held, tried = [data], size  # in an encoded stretch: another look after one more piece
            continue
        cut = size - m.start() if m else size
        yield data[:cut]
        start = max(0, cut - OVERLAP)
        start = data.find(b"\n", start, cut) + 1 or start
        held, size, old, tried = [data[start:]], size - start, cut - start, 0
    if size > old:
        yield b"".join(held)


def unbase64(stretch: bytes):
    """The bytes of a stretch read from each of its first four characters.

    A group of four is decoded by itself, so every later start is the end of one of these.
    """
    body = stretch.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    for at in range(4):
        part = body[at:]
        if len(part) % 4 == 1:
            part = part[:-1]
        yield base64.b64decode(part + b"=" * (-len(part) % 4))


def is_text(plain: bytes) -> bool:
    try:
        plain.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return not any(c < 32 and c not in b"\t\n\r" for c in plain)


def decoded(layer: bytes, starts, ends):
    """The layers that are encoded in a layer, one step down."""
    placed = starts is None or not isinstance(starts, int)
    steps = []
    if b"%" in layer:
        steps.append((URL, lambda m: bytes((int(m[1:], 16),))))
    if any(x in layer for x in (b"\\u", b"\\x", b"&#")):
        steps.append((UNICODE, utf8_of))
        if HIGH.search(layer):
            steps.append((BYTES, byte_of))
    for pattern, decode in steps:
        got = unescape(layer, pattern, decode, placed)
        if got and got[0]:
            plain, a, b = got
            if not placed:
                yield plain, starts, ends, True
            elif starts is None:
                yield plain, a, b, True
            else:
                yield plain, starts[a], ends[b - 1], True
    for pattern in (BASE64, WRAPPED) if b"\n" in layer else (BASE64,):
        for m in pattern.finditer(layer):
            for plain in unbase64(m[0].translate(None, b"\r\n\t ")):
                if plain:
                    yield plain, *back(starts, ends, *m.span()), is_text(plain)
    at = 0
    while m := MAGIC.search(layer, at):
        used = []
        some = sum(map(len, inflate(layer, m.start(), used)))  # a pass of its own for the end of the data
        at, end = used[-1]
        if some:
            a, b = back(starts, ends, m.start(), end)
            for plain in pieces(inflate(layer, m.start(), [])):
                yield plain, a, b, True
    if b"\0" in layer:
        for m in UTF16.finditer(layer):
            yield m[0].replace(b"\0", b""), *back(starts, ends, *m.span()), True


def back(starts, ends, a, b):
    """The place in the text of bytes a to b of a layer."""
    if starts is None:
        return a, b
    if isinstance(starts, int):
        return starts, ends
    return int(starts[a:b].min()), int(ends[a:b].max())


def scan(data: bytes) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int]:
    """Base findings of the text, the findings of all layers, and the number of layers; byte offsets.

    Decoded bytes that are no text count as a layer if a finding or another layer is in them.
    """
    base = find(data)
    found = set(base)
    # a layer: its bytes, where each byte came from (None: the text itself; ints: one stretch), and
    # if it counts in any case; the worklist holds steps, so that of a long stream one piece is in memory
    seen, layers = {(hashlib.sha256(data).digest(), 0, len(data))}, 1
    work = [[decoded(data, None, None), True]]
    while work:
        got = next(work[-1][0], None)
        if got is None:
            work.pop()
            continue
        plain, a, b, sure = got
        key = (hashlib.sha256(plain).digest(), *((a, b) if isinstance(a, int) else (int(a.min()), int(b.max()))))
        if key in seen:
            continue
        seen.add(key)
        hits = find(plain)
        for x, kind, y in hits:
            x, y = back(a, b, x, y)
            found.add((x, kind, y))
        sure = sure or bool(hits)
        if sure and not work[-1][1]:
            layers, work[-1][1] = layers + 1, True
        layers += sure
        work.append([decoded(plain, a, b), sure])
    return base, found, layers


def points(data: bytes, spans) -> list[tuple[int, int, int]]:
    """Byte offsets to code point offsets, in order of start and kind."""
    spans = sorted(spans)
    if not spans or data.isascii():
        return spans
    at = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return sorted((int(at[a]), k, int(at[b])) for a, k, b in spans)


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, base digest, all spans and the number of layers."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1):
                t = t.as_buffer()
                data = t.to_pybytes() if t is not None else b""
                base, found, layers = scan(data)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(told(points(data, base)).encode()).hexdigest()
                out.append((*n, digest, told(points(data, found)), layers))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in out], f.type) for k, f in enumerate(list(SCHEMA)[1:]))],
                schema=SCHEMA)

    return (docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
            .mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                             "spans string, n_layers long"))
