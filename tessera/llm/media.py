"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic number in one pass over the bytes;
a validator for each format walks its structure and lengths from there, so that
a chance hit (text that holds ``GIF89a``) is refused. The media at offset 0
gives the true type, which corrects the declared one; valid media further on
are carved out. Rows are handled one by one in Arrow batches; nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, materialize

#: Fixed values of the formats: magic number, its place in the file, type.
MAGICS = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "riff"),
    (b"BM", 0, "image/bmp"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
)
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, at, kind in MAGICS:
        a.add_word(magic.decode("latin-1"), (len(magic), at, kind))
    a.make_automaton()
    return a


def png_end(b: bytes, i: int) -> int | None:
    """End of the PNG at i: chunks with right checksums from IHDR to IEND."""
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if struct.unpack_from(">I", b, at + 8 + n)[0] != zlib.crc32(b[at + 4 : at + 8 + n]):
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return None


def gif_end(b: bytes, i: int) -> int | None:
    """End of the GIF at i: screen, blocks with their sub-block chains, trailer."""

    def chain(at: int) -> int | None:
        while at < len(b):
            if not b[at]:
                return at + 1
            at += 1 + b[at]
        return None

    if i + 13 > len(b):
        return None
    at = i + 13 + (3 * 2 ** ((b[i + 10] & 7) + 1) if b[i + 10] & 0x80 else 0)
    images = 0
    while at is not None and at < len(b):
        if b[at] == 0x3B:
            return at + 1 if images else None
        if b[at] == 0x21:
            at = chain(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            images += 1
            at = chain(at + 10 + (3 * 2 ** ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def jpeg_end(b: bytes, i: int) -> int | None:
    """End of the JPEG at i: marker segments, at least one frame and scan, end of image."""
    at, frames = i + 2, 0
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xD9:
            return None
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return None
        frames += 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if mark == 0xDA:
            while True:  # entropy-coded data: FF is followed by 00 or a restart mark until the next marker
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b):
                    return None
                if b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7:
                    at += 2
                else:
                    break
            if b[at + 1] == 0xD9:
                return at + 2 if frames else None
    return None


def riff(b: bytes, i: int) -> tuple[str, int] | None:
    """(type, end) of the RIFF file at i: known form, chunks that fill its size."""
    if i + 12 > len(b):
        return None
    n, form = struct.unpack_from("<I4s", b, i + 4)
    end = i + 8 + n
    if form not in RIFF_KINDS or end > len(b):
        return None
    at, names = i + 12, set()
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, at)
        names.add(name)
        at += 8 + size + size % 2
    if at != end or (form == b"WAVE" and not {b"fmt ", b"data"} <= names):
        return None
    return RIFF_KINDS[form], end


def bmp_end(b: bytes, i: int) -> int | None:
    if i + 30 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, i + 2)
    planes, bits = struct.unpack_from("<HH", b, i + 26)
    good = not zero and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size
    return i + size if good and i + size <= len(b) else None


def ogg_end(b: bytes, i: int) -> int | None:
    at, pages = i, 0
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and b[at + 4] == 0:
        k = b[at + 26]
        if at + 27 + k > len(b):
            return None
        last, at, pages = b[at + 5] & 4, at + 27 + k + sum(b[at + 27 : at + 27 + k]), pages + 1
        if at > len(b):
            return None
        if last:
            return at
    return None


class Marks:
    """Where a blob's PDF and ZIP files can end, looked up once a blob, so that many false starts cost no more than one."""

    def __init__(self, blob: bytes) -> None:
        self.blob = blob

    @cached_property
    def pdf(self) -> tuple[list[int], list[int]]:
        return self._places(b"%%EOF"), self._places(b"startxref")

    @cached_property
    def zip(self) -> dict[int, int]:
        """The end of each ZIP file by its start: an end record says how far before it the file begins."""
        b, out = self.blob, {}
        for at in self._places(b"PK\x05\x06"):
            if at + 22 <= len(b):
                size, offset, note = struct.unpack_from("<IIH", b, at + 12)
                start, end = at - size - offset, at + 22 + note
                if start >= 0 and end <= len(b) and b[start + offset : start + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    out.setdefault(start, end)
        return out

    def _places(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.blob)]


def pdf_end(b: bytes, i: int, marks: Marks) -> int | None:
    """End of the PDF at i: version digit, a cross-reference pointer, the next end mark."""
    if not b[i + 5 : i + 6].isdigit():
        return None
    ends, pointers = marks.pdf
    k, j = bisect_left(ends, i), bisect_left(pointers, i)
    return ends[k] + 5 if k < len(ends) and j < len(pointers) and pointers[j] < ends[k] else None


def zip_end(b: bytes, i: int, marks: Marks) -> int | None:
    return marks.zip.get(i)


ENDS = {"image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "image/bmp": bmp_end, "audio/ogg": ogg_end, "application/pdf": pdf_end, "application/zip": zip_end}
#: Types whose end is looked up among the marks of the whole blob.
MARKED = ("application/pdf", "application/zip")


def sniff(blob: bytes, machine: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of all valid media of ``blob``, outermost first, none inside another."""
    found, past, marks = [], 0, Marks(blob)
    for at, (n, place, kind) in (machine or _automaton()).iter(blob.decode("latin-1")):
        i = at - n + 1 - place
        if i < past:
            continue
        if kind == "riff":
            hit = riff(blob, i)
        else:
            e = ENDS[kind](blob, i, marks) if kind in MARKED else ENDS[kind](blob, i)
            hit = (kind, e) if e else None
        if hit:
            found.append((i, hit[1], hit[0]))
            past = hit[1]
    return found


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """A WAV file of 8-bit mono samples (an odd number of bytes is padded outside the data chunk)."""
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def wav_samples(blob: bytes, start: int = 0) -> bytes:
    """The data chunk of the WAV file at ``start``."""
    at = start + 12
    while True:
        name, size = struct.unpack_from("<4sI", blob, at)
        if name == b"data":
            return blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def sniff_column(df: DataFrame, *, row_id: str, media: str, declared: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, declared, corrected, valid, embedded[start, length, type]) of each row's bytes, and the columns ``keep``.

    ``corrected``: the type of the valid media that starts at byte 0, else
    application/octet-stream. Null bytes count as empty. ``embedded`` lists what
    else is found, in order, from which the media can be cut. One blob is in
    memory at a time besides its Arrow batch.
    """
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    given = df.select(F.col(row_id).alias("id"), F.col(declared).alias("declared"), *kept, F.col(media).alias("_media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for b in batches:
            found = [sniff(x.as_py() or b"", machine) for x in b.column(b.num_columns - 1)]
            top = [f[0] if f and f[0][0] == 0 else None for f in found]
            rest = [[{"start": s, "length": e - s, "type": t} for s, e, t in f[1 if o else 0 :]] for f, o in zip(found, top, strict=True)]
            out = [pa.array([o[2] if o else "application/octet-stream" for o in top], pa.string()), pa.array([o is not None for o in top], pa.bool_()), pa.array(rest, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*b.schema.names[:-1], "corrected", "valid", "embedded"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())]))
    schema = T.StructType([*given.schema[:-1], T.StructField("corrected", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("embedded", kind)])
    return mapped(given, run, schema).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def store_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", declared: str = "image/png") -> DataFrame:
    """(doc_id, n_bytes, media, declared): every text as the samples of a WAV file, written to the shared folder.

    The payload is the UTF-8 text (null: empty) and zero bytes up to a positive
    multiple of 64. The declared type is wrong on purpose, for sniffing to correct.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def stored(t: str | None) -> tuple[int, bytes]:
        raw = (t or "").encode()
        return len(raw), wav(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [stored(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return materialize(mapped(given, run, f"doc_id {kind}, n_bytes long, media binary").withColumn("declared", F.lit(declared)), "media")


def stored_texts(docs: DataFrame, **options) -> DataFrame:
    """What ``sniff_column`` finds in the column that ``store_texts`` wrote, and the payloads read back from it.

    ``feature``: corrected type, how often each nibble leads a byte in
    thousandths, and the number of media carved from inside the payload.
    """
    found = sniff_column(store_texts(docs, **options), row_id="doc_id", media="media", declared="declared", keep=("n_bytes", "media"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "corrected", "embedded"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(blob: bytes, corrected: str, inner: int) -> tuple:
        if corrected != "audio/wav":
            raise ValueError("the stored form isn't the WAV file that was written")
        payload = wav_samples(blob)
        feature = f"{corrected};{'.'.join(map(str, _nibbles(payload)))};{inner}"
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for b in batches:
            rows = [row(m.as_py(), c.as_py(), len(sniff(wav_samples(m.as_py()), machine))) for m, c in zip(b.column(2), b.column(4), strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols[:6], b.column(3), b.column(4), cols[6]], names)

    kind = found.schema["id"].dataType.simpleString()
    given = found.select("id", "n_bytes", "media", "declared", "corrected")
    return mapped(given, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, corrected string, embedded long")


def _nibbles(payload: bytes) -> list[int]:
    import numpy as np

    n = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return (n * 1000 // len(payload)).tolist()
