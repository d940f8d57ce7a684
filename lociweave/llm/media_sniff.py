"""Media columns by signature sniffing (operator 5).

An Aho-Corasick automaton over the magic bytes of all known formats finds every
place in a byte string where a media file may begin; a validator per format then
checks the header's structure and its lengths and says how long the file is.
The first valid file at offset 0 corrects a wrong declared type, and the others
are carved out as embedded media.

The work is one pass over the rows without a shuffle; memory is one row's bytes
at a time beside the Arrow batch, and a validator's work grows with the bytes (but for
the checksums of PNG chunks that overlap).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociweave.llm.common import doc_frame

#: Payloads are padded with blanks to a multiple of this many bytes.
ROW = 192
PIXELS = ROW // 3

#: Media go back to Spark in pieces of about so many bytes.
PIECE = 64 << 20


class Source:
    """A byte string with what its validators have found out about places in it.

    Chains of blocks that begin at different magic bytes run into each other: what follows a place
    is the same for all of them, so it is walked once, and hostile bytes cost no more than
    their length per format.
    """

    def __init__(self, b: bytes):
        self.b = b
        self.ends: dict[tuple[str, int], int] = {}
        self._line = (0, 0)

    def line_end(self, at: int) -> int:
        """Place of the next newline or return, the end of the bytes if there is none."""
        if not self._line[0] <= at <= self._line[1]:
            ends = [x for x in (self.b.find(b"\n", at), self.b.find(b"\r", at)) if x >= 0]
            self._line = (at, min(ends, default=len(self.b)))
        return self._line[1]

    def chain(self, kind: str, at: int, step: Callable[[int], int]) -> int:
        """Where a chain of blocks from a place on ends, 0 if it breaks: ``step`` gives the next
        block's place, minus the end's place where it ends, or 0 where it breaks."""
        passed = []
        while (kind, at) not in self.ends:
            passed.append(at)
            after = step(at)
            if after <= 0:
                self.ends[kind, at] = -after
                break
            at = after
        end = self.ends[kind, at]
        self.ends.update(((kind, p), end) for p in passed)
        return end


def _wav_chunks(b: bytes, at: int) -> tuple[int, tuple[int, ...], int, int] | None:
    """(end, format, data's place and size) of a WAV file whose chunks fill it exactly."""
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, p, form, data = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, None, None
    while p + 8 <= end <= len(b):
        kind, size = struct.unpack_from("<4sI", b, p)
        if kind == b"fmt " and form is None and 16 <= size and p + 24 <= end:
            form = struct.unpack_from("<HHIIHH", b, p + 8)
        elif kind == b"data" and form and data is None:
            data = (p + 8, size)
        p += 8 + size + size % 2
    if form is None or data is None or p - end not in (0, 1) or data[0] + data[1] > end:
        return None
    code, channels, rate, per_s, align, bits = form
    sound = code in (1, 0xFFFE) and bits in (8, 16, 24, 32) and channels and align == channels * bits // 8 and per_s == rate * align and data[1] % align == 0
    return (end, form, *data) if sound else None


def wav_length(f: Source, at: int) -> int:
    """Length of a valid PCM WAV file at an offset, of any chunks and 8 to 32 bits, else 0."""
    found = _wav_chunks(f.b, at)
    return found[0] - at if found else 0


def _bmp_head(b: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """(total, offset of the pixels, width, height, bytes a row holds and takes) of a BMP file."""
    if len(b) - at < 54:
        return None
    total, _, offset, head, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if head not in (40, 108, 124) or planes != 1 or depth not in (8, 24, 32) or packed not in (0, 3 if depth == 32 else 0) or width <= 0 or not height or offset < 14 + head:
        return None
    stride = (width * depth + 31) // 32 * 4
    need = offset + stride * abs(height)
    return (total, offset, width, height, width * depth // 8, stride) if need <= total <= need + 3 and at + total <= len(b) else None


def bmp_length(f: Source, at: int) -> int:
    """Length of a valid uncompressed BMP file of 8, 24 or 32 bits at an offset, else 0."""
    found = _bmp_head(f.b, at)
    return found[0] if found else 0


def _pnm_head(f: Source, at: int) -> tuple[int, int, int, int] | None:
    """(place of the samples, width, height, largest sample) of a binary PGM or PPM header."""
    b, p, numbers = f.b, at + 2, []
    while len(numbers) < 3:
        if not b[p : p + 1].isspace() and b[p : p + 1] != b"#":
            return None
        while b[p : p + 1].isspace() or b[p : p + 1] == b"#":
            p = f.line_end(p) if b[p] == 35 else p + 1
        digits = 0
        while b[p + digits : p + digits + 1].isdigit() and digits < 11:
            digits += 1
        if not 0 < digits < 11:
            return None
        numbers.append(int(b[p : p + digits]))
        p += digits
    return (p + 1, *numbers) if b[p : p + 1].isspace() else None


def pnm_length(f: Source, at: int) -> int:
    """Length of a valid binary PGM or PPM file of 8-bit samples at an offset, else 0."""
    head = _pnm_head(f, at)
    if not head or not 0 < head[3] < 256:
        return 0
    size = head[1] * head[2] * (1 if f.b[at + 1] == 53 else 3)
    return head[0] - at + size if size and head[0] + size <= len(f.b) else 0


def png_length(f: Source, at: int) -> int:
    """Length of a PNG file at an offset whose chunks have right lengths and checksums, else 0."""
    b = f.b

    def step(p: int) -> int:
        if p + 12 > len(b):
            return 0
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        return -end if kind == b"IEND" else end

    end = f.chain("png", at + 8, step) if b[at + 8 : at + 16] == b"\x00\x00\x00\rIHDR" else 0
    return end - at if end else 0


def gif_length(f: Source, at: int) -> int:
    """Length of a GIF file at an offset whose block chain reaches the trailer, else 0."""
    b = f.b
    table = lambda p: 3 << (b[p] & 7) + 1 if b[p] & 128 else 0

    def piece(p: int) -> int:
        """The next sub-block, or the place after the last one."""
        return 0 if p >= len(b) else p + b[p] + 1 if b[p] else -(p + 1)

    def step(p: int) -> int:
        if p >= len(b) or b[p] == 0x3B:
            return -(p + 1) if p < len(b) else 0
        if b[p] == 0x2C and p + 10 < len(b):
            return f.chain("gif piece", p + 11 + table(p + 9), piece)
        return f.chain("gif piece", p + 2, piece) if b[p] == 0x21 else 0

    end = f.chain("gif", at + 13 + table(at + 10), step) if len(b) - at >= 14 else 0
    return end - at if end else 0


#: Frame markers of JPEG: they hold the picture's size.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _jpeg_frame(b: bytes, at: int) -> tuple[int, int]:
    """Width and height in the first frame header, zero where there is none."""
    p = at + 2
    while p + 9 <= len(b) and b[p] == 0xFF:
        if b[p + 1] in _FRAMES:
            height, width = struct.unpack_from(">HH", b, p + 5)
            return width, height
        if b[p + 1] in (0xDA, 0xD9):
            break
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return 0, 0


def jpeg_length(f: Source, at: int) -> int:
    """Length of a JPEG file at an offset whose marker chain has a frame and reaches the end, else 0."""
    b = f.b

    def step(p: int) -> int:
        if p + 2 > len(b) or b[p] != 0xFF:
            return 0
        mark = b[p + 1]
        if mark == 0xD9:
            return -(p + 2)
        if mark == 0xFF:  # a fill byte
            return p + 1
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8 or p + 4 > len(b):
            return 0
        after = p + 2 + struct.unpack_from(">H", b, p + 2)[0]
        if after < p + 4:
            return 0
        while mark == 0xDA:  # coded data, to the next marker that is no restart
            after = b.find(b"\xff", after)
            if after < 0 or after + 1 >= len(b):
                return 0
            if b[after + 1] and not 0xD0 <= b[after + 1] <= 0xD7:
                break
            after += 2
        return after

    end = f.chain("jpeg", at + 2, step)
    return end - at if end and all(_jpeg_frame(b, at)) else 0


def zip_length(f: Source, at: int) -> int:
    """Length of the ZIP archive whose end record is at an offset and whose directory, of whole entries,
    ends there, else 0."""
    b = f.b
    if at + 22 > len(b):
        return 0
    disk, first, here, n, size, offset, comment = struct.unpack_from("<HHHHIIH", b, at + 4)
    begin, p = at - size - offset, at - size
    if disk or first or here != n or not n or begin < 0 or b[begin : begin + 4] != b"PK\x03\x04" or at + 22 + comment > len(b):
        return 0
    for _ in range(n):
        if p + 46 > at or b[p : p + 4] != b"PK\x01\x02":
            return 0
        p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
    return at + 22 + comment - begin if p == at else 0


#: Media type, magic bytes, validator.  A ZIP archive is found by its end record.
FORMATS: list[tuple[str, bytes, Callable[[Source, int], int]]] = [
    ("audio/wav", b"RIFF", wav_length),
    ("image/bmp", b"BM", bmp_length),
    ("image/x-portable-graymap", b"P5", pnm_length),
    ("image/x-portable-pixmap", b"P6", pnm_length),
    ("image/png", b"\x89PNG\r\n\x1a\n", png_length),
    ("image/gif", b"GIF87a", gif_length),
    ("image/gif", b"GIF89a", gif_length),
    ("image/jpeg", b"\xff\xd8\xff", jpeg_length),
    ("application/zip", b"PK\x05\x06", zip_length),
]


def automaton() -> ahocorasick.Automaton:
    """Aho-Corasick automaton over the magic bytes, as Latin-1 characters."""
    found = ahocorasick.Automaton()
    for number, (_, magic, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), number)
    found.make_automaton()
    return found


def carve(b: bytes, finder: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all valid media files in a byte string, in order; files
    within a file that was already found are listed too."""
    found, source = [], Source(b)
    for end, number in finder.iter(b.decode("latin-1")):
        kind, magic, length = FORMATS[number]
        at = end + 1 - len(magic)
        if n := length(source, at):
            if kind == "application/zip":  # the length counts back from the end record's end
                at += 22 + struct.unpack_from("<H", b, at + 20)[0] - n
            found.append((at, n, kind))
    return sorted(found)


def store(payload: bytes) -> bytes:
    """A payload as the 8-bit samples of a WAV, BMP or PGM file; its checksum picks the format."""
    n, pick = len(payload), zlib.crc32(payload) % 3
    if pick == 0:
        return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", n + 36, b"WAVEfmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if pick == 1:
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", n + 54, 0, 54, 40, PIXELS, -(n // ROW), 1, 24, 0, n, 0, 0, 0, 0) + payload
    return b"P5\n%d %d\n255\n" % (ROW, n // ROW) + payload


#: PNG files with more bytes of samples than this are sized and not unpacked.
MAX_SAMPLES = 64 << 20


def _png_samples(b: bytes, at: int, n: int, width: int, height: int) -> bytes:
    """The samples of a PNG file of 8-bit channels without interlacing, row by row; none of other kinds."""
    depth, colour, _, _, interlaced = b[at + 24 : at + 29]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    stride = width * channels
    if depth != 8 or interlaced or not channels or not 0 < (stride + 1) * height <= MAX_SAMPLES:
        return b""
    packed, p = [], at + 8
    while p < at + n:
        size, kind = struct.unpack_from(">I4s", b, p)
        packed += [b[p + 8 : p + 8 + size]] if kind == b"IDAT" else []
        p += 12 + size
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), (stride + 1) * height)
    except zlib.error:
        return b""
    if len(raw) < (stride + 1) * height:
        return b""
    rows, above = np.frombuffer(raw, np.uint8).reshape(height, stride + 1), np.zeros(stride, np.uint8)
    out = np.empty((height, stride), np.uint8)
    for y in range(height):
        how, line = rows[y, 0], rows[y, 1:]
        if how == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            line = _refilled(line.tolist(), above.tolist(), channels, how)
        elif how:
            return b""
        out[y] = above = line
    return out.tobytes()


def _refilled(line: list[int], above: list[int], channels: int, how: int) -> np.ndarray:
    """A row whose bytes were stored as differences from an average (3) or from the nearest neighbour (4)."""
    for i in range(len(line)):
        left, up = line[i - channels] if i >= channels else 0, above[i]
        if how == 3:
            line[i] = (line[i] + (left + up) // 2) & 255
        else:
            corner = above[i - channels] if i >= channels else 0
            guess = left + up - corner
            line[i] = (line[i] + min((left, up, corner), key=lambda v: abs(guess - v))) & 255
    return np.array(line, np.uint8)


def samples(b: bytes, at: int, n: int, kind: str) -> tuple[bytes, str]:
    """The samples of a valid file and its shape: WAV data, the rows of BMP (from the top, without
    padding), PGM, PPM and PNG; none of GIF, JPEG and ZIP."""
    if kind == "audio/wav":
        _, (_, channels, rate, _, _, bits), p, size = _wav_chunks(b, at)
        return b[p : p + size], f"rate={rate}" + f",channels={channels}" * (channels > 1) + f",bits={bits}" * (bits > 8)
    if kind == "image/bmp":
        _, offset, width, height, own, stride = _bmp_head(b, at)
        rows = range(abs(height)) if height < 0 else range(height - 1, -1, -1)
        whole = b[at + offset : at + offset + stride * abs(height)]
        return whole if own == stride and height < 0 else b"".join(whole[y * stride : y * stride + own] for y in rows), f"size={width}x{abs(height)}"
    if kind.startswith("image/x-portable"):
        p, width, height, _ = _pnm_head(Source(b), at)
        return b[p : at + n], f"size={width}x{height}"
    if kind == "application/zip":
        return b"", f"entries={struct.unpack_from('<H', b, b.rfind(b'PK' + bytes([5, 6]), at, at + n) + 10)[0]}"
    if kind == "image/jpeg":
        width, height = _jpeg_frame(b, at)
        return b"", f"size={width}x{height}"
    if kind == "image/png":
        width, height = struct.unpack_from(">II", b, at + 16)
        return _png_samples(b, at, n, width, height), f"size={width}x{height}"
    width, height = struct.unpack_from("<HH", b, at + 6)
    return b"", f"size={width}x{height}"


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with blanks up to a positive multiple of ROW, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), len(raw)


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, declared_type string"
SNIFF_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, media_type string, corrected boolean, n_embedded long"


def text_media(docs: DataFrame, declared: str = "image/bmp") -> DataFrame:
    """(doc_id, n_bytes, media, declared_type): every whole text as a media file, all
    under one declared type, as a crawler's defaults would have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, rows = 0, 0, []
            for row, text in enumerate(batch.column(1), 1):
                payload, n = padded(text.as_py())
                rows.append((n, store(payload)))
                held += len(payload)
                if held >= PIECE or row == len(batch):
                    yield pa.record_batch([batch.column(0).slice(first, len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary()), pa.array([declared] * len(rows))], names=["doc_id", "n_bytes", "media", "declared_type"])
                    first, held, rows = row, 0, []

    return doc_frame(docs).mapInArrow(run, MEDIA_SCHEMA)


def sniff(media: DataFrame) -> DataFrame:
    """Sniff, validate and read back a media column (doc_id, n_bytes, media, declared_type).

    media_type is the type of the valid file at offset 0 (null if there is none, and
    then no payload is read); corrected says that it differs from declared_type;
    n_embedded counts the valid files at later offsets, nested ones too.  Samples are
    read from WAV, BMP, PGM, PPM and PNG files (8-bit channels, not interlaced); other files have an
    empty payload and their size as the feature.  The feature's figures are of bytes.  A null media value counts as empty bytes; rows that repeat come back
    as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = automaton(), [x.split()[0] for x in SNIFF_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, n, media, declared in zip(*batch.columns, strict=True):
                b, kind = media.as_py() or b"", declared.as_py()
                files = carve(b, finder)
                own = next((f for f in files if f[0] == 0), None)
                payload, shape = samples(b, *own) if own else (b"", "")
                head = np.frombuffer(payload, np.uint8)
                feature = f"{own[2]};{shape}" if own else ""
                feature += f";mean={head.mean():.6f};std={head.std():.6f};max={head.max()}" if len(head) else ""
                rows.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature, kind, own and own[2], bool(own and own[2] != kind), sum(f[0] > 0 for f in files)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 12, types, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media", "declared_type").mapInArrow(run, SNIFF_SCHEMA)


def carve_media(media: DataFrame) -> DataFrame:
    """(doc_id, at, length, media_type, file): all valid media files of a media column, carved.

    Files within another file are carved too, and of two formats that are valid at one
    offset both; null and empty values have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            for doc_id, media_value in zip(batch.column(0), batch.column(1), strict=True):
                b = media_value.as_py() or b""
                for at, n, kind in carve(b, finder):
                    yield pa.record_batch([pa.array([doc_id.as_py()], pa.int64()), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([kind]), pa.array([b[at : at + n]], pa.binary())], names=["doc_id", "at", "length", "media_type", "file"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, at long, length long, media_type string, file binary")
