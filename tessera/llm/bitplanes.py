"""Token ids in binary files: bit-plane shuffling.

A file holds fixed-size blocks of ids. A block is transposed into its byte
planes (all lowest bytes, then all second bytes, ...) or bit planes, each
compressed with zstandard: the high planes of a vocabulary's ids are nearly
constant. A footer holds the chunk index (place, ids and plane lengths of each
block) and the documents' ids and lengths, so a block can be read alone.

Layout: magic, blocks, footer (zstandard), footer length (u32), magic.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch, shuffle_parts
from .tokens import default_path, encoder

MAGIC = b"TBPL0001"
BLOCK = 1 << 16
END_ID = 2
#: Ids and documents after which a file ends and the next one begins.
ROLL_IDS, ROLL_DOCS = 1 << 26, 1 << 18


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of u32 ``ids``: 4 byte planes or 32 bit planes, lowest first."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if unit == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in by_byte]
    return [np.packbits((by_byte[k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """``to_planes`` undone for ``n`` ids."""
    if len(planes) == 4:
        return np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class Writer:
    """Writes documents' ids to a file; memory is one block, a document and the file's table of documents."""

    def __init__(self, sink, unit: str = "byte", block: int = BLOCK) -> None:
        self.sink, self.unit, self.block = sink, unit, block
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.at = sink.write(MAGIC) or len(MAGIC)
        self.at, self.open, self.blocks, self.docs, self.ids = len(MAGIC), bytearray(), [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.ids += len(ids) // 4
        self.open += ids
        while len(self.open) >= 4 * self.block:
            self._flush(4 * self.block)

    def _flush(self, n: int) -> None:
        planes = [self.compress(p) for p in to_planes(np.frombuffer(bytes(self.open[:n]), "<u4"), self.unit)]
        del self.open[:n]
        self.sink.write(b"".join(planes))
        self.blocks.append([self.at, n // 4, [len(p) for p in planes]])
        self.at += sum(map(len, planes))

    def close(self) -> int:
        """Writes the rest and the footer; the number of ids."""
        if self.open:
            self._flush(len(self.open))
        foot = self.compress(json.dumps({"blocks": self.blocks, "docs": self.docs}).encode())
        self.sink.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        return self.ids


class Reader:
    """Reads a file through a seekable source."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        tail = self._at(end - 12, 12)
        if self._at(0, 8) != MAGIC or tail[4:] != MAGIC:
            raise ValueError("not a bit-plane file, or a cut one")
        n = struct.unpack("<I", tail[:4])[0]
        foot = json.loads(zstandard.ZstdDecompressor().decompress(self._at(end - 12 - n, n)))
        self.blocks, self.docs = foot["blocks"], foot["docs"]

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, lengths = self.blocks[k]
        raw, planes, undo = self._at(at, sum(lengths)), [], zstandard.ZstdDecompressor()
        for size in lengths:
            planes.append(undo.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, number of ids, crc32 of the ids) in order, a block at a time."""
        k, have = 0, b""
        for doc_id, n in self.docs:
            need, crc = 4 * n, 0
            while need:
                if not have:
                    have, k = memoryview(self.block(k).tobytes()), k + 1
                crc = zlib.crc32(have[:need], crc)
                used = min(need, len(have))
                have, need = have[used:], need - used
            yield doc_id, n, crc


def write_ids(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, unit: str = "byte") -> list[tuple[str, int, int]]:
    """Encode every text and write the files of ``folder`` in ascending doc_id order.

    Returns (path, documents, ids) of the files in order: a row a file. A range
    of doc_id is a file, or several of at least ROLL_IDS ids or ROLL_DOCS
    documents each, so a file's table stays bounded. Null texts count as empty and give the end id alone;
    null doc_ids come first; rows with one doc_id are ordered by their text. A
    file's name holds a fresh mark, and only files of tasks that ended count, so
    a task that is run again does no harm.
    """
    path, parts = tokenizer or default_path(), shuffle_parts(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, sink, writer, encode = TaskContext.get().partitionId(), 0, None, None, encoder(path)

        def closed() -> pa.RecordBatch:
            n = writer.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"part": [part], "turn": [turn], "name": [name], "docs": [len(writer.docs)], "ids": [n]})

        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                if writer is None:
                    fs, at = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(at, recursive=True)
                    name = f"ids-{part:06d}-{turn:06d}-{uuid.uuid4().hex}.planes"
                    sink = fs.open_output_stream(f"{at}/{name}")
                    writer = Writer(sink, unit)
                writer.add(d.as_py(), encode(t.as_py()) + end)
                if writer.ids >= ROLL_IDS or len(writer.docs) >= ROLL_DOCS:
                    yield closed()
                    writer, turn = None, turn + 1
        if writer is not None:
            yield closed()

    found = mapped(rows, run, "part long, turn long, name string, docs long, ids long").collect()
    return [(f"{folder}/{r['name']}", r["docs"], r["ids"]) for r in sorted(found, key=lambda r: (r["part"], r["turn"]))]


def read_ids(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    rows, base = [], 0
    for path, _, n in files:
        rows.append((path, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                fs, at = pafs.FileSystem.from_uri(f["path"])
                with fs.open_input_file(at) as source:
                    start, out = f["base"], []
                    for d, n, crc in Reader(source).documents():
                        out.append((d, start, n, crc))
                        start += n
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    named = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return mapped(named, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """``write_ids`` to a new shared folder, then ``read_ids``. An empty table gives no rows."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, scratch(spark, "ids"), **options))
