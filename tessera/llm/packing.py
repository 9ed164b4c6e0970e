"""Packing documents into sequences: cutting stock by column generation.

Documents are cut into full sequences and a rest. The histogram of the rests'
lengths in units of GRAIN ids, rounded up (at most capacity / GRAIN numbers,
whatever the input's size), is the demand of a cutting-stock linear program over
patterns, multisets of lengths that fit a sequence. Knapsack dynamic programming
prices new patterns until none improves the bound by more than ``gap``; the
solution is rounded down and what is left is placed best-fit. Patterns are
handed to documents by rank within their length, slice by slice of the stream,
so sequences follow the documents' order. Rounding to GRAIN costs less
than GRAIN ids a rest and keeps the program a few hundred rows wide.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exclusive_prefix, mapped, materialize, shuffle_parts
from .tokens import default_path, encoder

CAPACITY = 1024
END_ID = 0
GRAIN = 4
#: Parts of the stream over which each pattern's sequences are spread.
SLICES = 64


def price(values: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The most valuable multiset of lengths within ``capacity``; values[l] is length l's, -inf if absent."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1][:c] + values[1 : c + 1]
        k = int(gain.argmax())
        best[c], take[c] = (gain[k], k + 1) if gain[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = Counter(), capacity
    while c > 0:
        pattern[int(take[c])] += 1 if take[c] else 0
        c -= int(take[c]) or 1
    return float(best[capacity]), +pattern


def patterns(demand: dict[int, int], capacity: int = CAPACITY, gap: float = 2e-3, rounds: int = 3000) -> list[tuple[Counter, int]]:
    """(pattern, copies) that cover ``demand`` (length: pieces) exactly.

    Revised simplex over generated columns. ``gap``: how far, relatively, the
    number of sequences of the linear program may stand above its lower bound.
    """
    demand = {k: v for k, v in demand.items() if v}
    if not demand:
        return []
    lengths = np.array(sorted(demand))
    place, m = {int(x): i for i, x in enumerate(lengths)}, len(lengths)
    d = np.array([demand[int(x)] for x in lengths], float)
    columns, x = _first_columns(lengths, d, capacity)
    inverse = _inverse(_matrix(columns, place))
    for step in range(rounds):
        y = inverse.sum(0)
        values = np.full(capacity + 1, -np.inf)
        values[lengths] = y
        worth, pattern = price(values, capacity)
        if worth <= 1 + gap:
            break
        a = np.zeros(m)
        for k, n in pattern.items():
            a[place[k]] = n
        u = (inverse * a).sum(1)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        t = ratio[r]
        x = np.maximum(x - t * u, 0)
        x[r] = t
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        columns[r] = pattern
        if step % 500 == 499:  # rounding errors don't add up
            inverse = _inverse(_matrix(columns, place))
            x = np.maximum((inverse * d).sum(1), 0)
    rest, out = Counter(demand), []
    for c, share in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        copies = min([int(share + 1e-7), *(rest[k] // n for k, n in c.items())])
        if copies:
            out.append((c, copies))
            for k, n in c.items():
                rest[k] -= n * copies
    return out + best_fit(+rest, capacity)


def _matrix(columns: list[Counter], place: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(columns), len(columns)))
    for i, c in enumerate(columns):
        for k, n in c.items():
            out[place[k], i] = n
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, element-wise: no threads of a BLAS beside the JVM's."""
    n = len(a)
    w = np.hstack((a, np.eye(n)))
    for k in range(n):
        r = k + int(np.abs(w[k:, k]).argmax())
        w[[k, r]] = w[[r, k]]
        w[k] /= w[k, k]
        factor = w[:, k].copy()
        factor[k] = 0
        rows = np.nonzero(factor)[0]
        w[rows] -= factor[rows, None] * w[k]
    return w[:, n:]


def _first_columns(lengths: np.ndarray, d: np.ndarray, capacity: int) -> tuple[list[Counter], np.ndarray]:
    """A first basis: patterns filled greedily, longest first, each used until a length runs out.

    A pattern stands in the column of the length it uses up and holds no length
    used up before, so the basis is triangular. Lengths that run out together
    with that one get a pattern of their own, unused.
    """
    left, columns, x = d.copy(), [Counter() for _ in lengths], np.zeros(len(lengths))
    while (left > 0).any():
        pattern, room = {}, capacity
        for i in range(len(lengths) - 1, -1, -1):
            if left[i] > 0 and (n := min(int(np.ceil(left[i])), room // int(lengths[i]))):
                pattern[i] = n
                room -= n * int(lengths[i])
        used = min(left[i] / n for i, n in pattern.items())
        out = [i for i, n in pattern.items() if left[i] / n <= used * (1 + 1e-12)]
        for i, n in pattern.items():
            left[i] -= used * n
        left[out] = 0
        columns[out[0]], x[out[0]] = Counter({int(lengths[i]): n for i, n in pattern.items()}), used
        for i in out[1:]:
            columns[i] = Counter({int(lengths[i]): capacity // int(lengths[i])})
    return columns, x


def best_fit(rest: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing of what rounding left: a few pieces for each pattern at most."""
    bins: list[list[Counter]] = [[] for _ in range(capacity + 1)]  # by room left
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            room = next((r for r in range(length, capacity + 1) if bins[r]), None)
            c = bins[room].pop() if room is not None else Counter()
            c[length] += 1
            bins[(room if room is not None else capacity) - length].append(c)
    same = Counter(tuple(sorted(c.items())) for b in bins for c in b)
    return [(Counter(dict(k)), n) for k, n in sorted(same.items())]


def cut(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, order: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, stream_part, stream_place) of each document's pieces; the last two are ``order``'s, else 0."""
    path, end = tokenizer or default_path(), np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "stream_part", "stream_place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out = []
            for d, p, q, t in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                ids = memoryview(encode(t.as_py()) + end)
                n = len(ids) // 4
                out += [(d, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n, p, q) for s in range(0, n, capacity)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    place = [F.col(c).cast("long") for c in order] if order else [F.lit(0).cast("long")] * 2
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), place[0].alias("p"), place[1].alias("q"), F.col(text).alias("text"))
    return mapped(rows, run, ", ".join(f"{c} long" for c in names))


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, order: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens) of each piece.

    sequence_tokens: ids of the whole sequence, which is padded to ``capacity``
    unless that is a power of two. A null or empty text is its end id alone. Each
    repeated row is packed. ``order``: two integer columns, a part of the stream
    and a place in it, by which documents are ranked, so early documents come
    into early sequences; else pieces of one length are ranked by (hash range,
    doc_id, start, checksum): pieces equal in all of these are alike.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, doc_id=doc_id, text=text, tokenizer=tokenizer, capacity=capacity, end_id=end_id, order=order), "pieces")
    pieces = pieces.withColumn("units", F.ceil(F.col("length") / GRAIN).cast("long"))
    units = capacity // GRAIN
    hist = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count("*").alias("n")).collect()}  # ``units`` rows at most
    full = hist.pop(units, 0)
    plan = patterns(hist, units)
    if full:
        plan.append((Counter({units: 1}), full))
    keys, base, each, seq, off = _places(spread(plan))
    bucket = F.col("stream_part") if order else F.pmod(F.xxhash64("doc_id", "start"), F.lit(4 * shuffle_parts(spark)))
    ranked = pieces.withColumn("one", F.lit(1).cast("long")).withColumn("bucket", bucket)
    ranked = exclusive_prefix(ranked, "bucket", [F.col("stream_place"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "one", "rank", within=("units",))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            q, s = np.divmod(rank - base[k], each[k])
            out = [seq[k] + q, off[k] + s * length]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *[pa.array(x, pa.int64()) for x in out]], [*b.schema.names[:5], "sequence_id", "slot"])

    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = mapped(ranked.select(*own, "units", "rank"), place, ", ".join(f"{c} long" for c in [*own, "sequence_id", "slot"]))
    inside = Window.partitionBy("sequence_id")  # at most ``units`` pieces
    offset = F.coalesce(F.sum("length").over(inside.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select(*own, "sequence_id", offset.alias("offset"), F.sum("length").over(inside).alias("sequence_tokens"))


def spread(plan: list[tuple[Counter, int]], slices: int = SLICES) -> list[tuple[Counter, int]]:
    """``plan`` with each pattern's copies dealt evenly over the slices, slice by slice.

    A pattern starts at a place of its own between two slices, so that patterns
    of few copies don't all fall into the same ones.
    """
    out = []
    for s in range(slices):
        for j, (c, copies) in enumerate(plan):
            start = int(j * 0.6180339887498949 % 1 * slices)
            n = ((s + 1) * copies + start) // slices - (s * copies + start) // slices
            if n:
                out.append((c, n))
    return out


def _places(plan: list[tuple[Counter, int]]) -> tuple[np.ndarray, ...]:
    """For each length's ranges of ranks: (key, first rank, pieces a sequence, first sequence, place in it).

    At most as many rows as the patterns have lengths, times the slices: bounded by the capacity, not by the input.
    """
    rows, used, sequence = [], Counter(), 0
    for c, copies in plan:
        at = 0
        for k in sorted(c, reverse=True):
            rows.append(((k << 44) + used[k], used[k], c[k], sequence, at))
            used[k] += c[k] * copies
            at += k * c[k]
        sequence += copies
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5
