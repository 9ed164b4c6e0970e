"""N-gram Jaccard join: grouped prefix join with exact verification.

Documents are sets of hashed word shingles. Two sets of Jaccard similarity of at
least ``percent`` / 100 share one of the first n - ceil(percent n / 100) + 1
shingles of either set in any common order; the order here puts shingles that
are frequent in the corpus last (by a fixed-size table of counts), so that
passages and lines that many documents share stay out of the prefixes.

1. Equal sets become one class, named by its smallest doc_id.
2. Classes with one prefix and one size become one group. Prefix shingles that
   only one group has are dropped at once.
3. Star round: among the groups of one shingle and similar size, stars are the
   one in whose order it comes first (so the least edited of a group of near
   copies) and some drawn by hash. A group meets the star that it shares most
   shingles with, a member of a group only the group's first. These pairs grow
   with the input, not with the square of a group of copies. They are verified
   on the whole sets, and the links' components found. The round only saves
   work: whatever it leaves unlinked is left to the next step.
4. What is left are pairs of different components. Their groups are joined on
   shingles that stand early enough in both orders for the pair's sizes, then
   expanded to members; inside a group, members are paired by what follows
   their prefix. Pairs whose parity sketches differ in more bits than
   linked sets can differ in members go; the others are verified. Pairs inside
   a component cannot change any class and are never formed.

So no link between different texts is lost, and no bucket is expanded into all
its pairs. Shingle sets are computed in Arrow batches; joins, counts and
verification stay in the JVM. Every intermediate table is written to the shared
folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copied, dealt, discard, exclusive_prefix, hot_keys, mapped, materialize, range_ordered, shuffle_parts, sliced_join

WORDS, PERCENT = 5, 75
#: The table of shingle counts has a slot a row of the corpus, rounded up to a power of two and to between these two
#: powers: at most 32 MB, whatever the corpus. It only orders shingles; its size changes no result.
TABLE_BITS, CHUNKS = (19, 23), 64
#: A shingle's stars drawn by hash, besides the one that has it earliest.
DRAWS = 1
#: A group meets a star only if it shares one in so many of its prefix shingles with it.
STAR_SHARE = 6
#: Longs of a set's parity sketch.
SKETCH = 8
#: Bytes of ids or pairs that are broadcast at most; more are joined by a shuffle.
BROADCAST = 8 << 20
#: Bytes of text hashed at once.
BLOCK = 1 << 18

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A number for each byte.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(base: int) -> np.ndarray:
    p = np.full(BLOCK + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _word_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, sum, length) of each word of at most BLOCK lower-cased bytes; the sum is of the word's byte numbers times powers of the base."""
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.nonzero(np.diff(space, prepend=True, append=True))[0]
    start, end = edge[::2], edge[1::2]
    # a word's share of the running sum is scaled back to its own start
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _powers(int(_BASE))[: len(b)], out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(pow(int(_BASE), -1, 1 << 64))[start]
    return start, h, (end - start).astype(np.uint64)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of at most BLOCK lower-cased bytes."""
    start, h, n = _word_sums(raw)
    return start, _mix(h + n)


def _long_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """The word hashes of a text of any length, and with words of any length, a block at a time."""
    part, size = 0, 0  # of the word that the blocks so far left open
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        start, h, n = _word_sums(block)
        if size and len(start) and start[0] == 0:
            h[0] = (part + int(h[0]) * pow(int(_BASE), size, 1 << 64)) % (1 << 64)
            n[0] += np.uint64(size)
        elif size:
            yield _mix(np.array([(part + size) % (1 << 64)], np.uint64))
        part, size = (int(h[-1]), int(n[-1])) if len(h) and not _SPACE[block[-1]] else (0, 0)
        yield _mix((h + n)[: -1 if size else None])
    if size:
        yield _mix(np.array([(part + size) % (1 << 64)], np.uint64))


def _shingles(w: np.ndarray, words: int) -> np.ndarray:
    h = w[: len(w) - words + 1].copy()
    for i in range(1, words):
        h = h * _BASE + w[i : len(w) - words + 1 + i]
    return _mix(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _long_set(raw: bytes, words: int) -> np.ndarray:
    w = np.concatenate([np.zeros(0, np.uint64), *_long_hashes(raw)])
    return _distinct(_shingles(w, min(words, len(w))) + np.uint64(min(words, len(w)))) if len(w) else w


def _slices(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, few of them as Python strings at once."""
    for at in range(0, len(texts), 128):
        yield from texts.slice(at, 128).to_pylist()


def shingle_sets(texts: Iterable[str | None], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(all sets' shingle hashes, ends of the sets) of successive texts, a block of texts at a time.

    A set is sorted and distinct. Fewer words: their sequence as one shingle; no
    words or null: empty. Memory is bounded by a block, or by one text beyond it.
    """

    def of(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.cumsum([len(x) + 1 for x in group])
        start, h = _word_hashes(b"\n".join(group))
        bounds = np.searchsorted(start, at)
        every = _shingles(h, words) + np.uint64(words) if len(h) >= words else None
        sets, first = [], 0
        for last in bounds:
            n = last - first
            if n >= words:
                sets.append(_distinct(every[first : last - words + 1]))
            else:
                sets.append(_shingles(h[first:last], n) + np.uint64(n) if n else h[:0])
            first = last
        return np.concatenate(sets), np.cumsum([len(x) for x in sets])

    group, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if group and size + len(raw) >= BLOCK:
            yield of(group)
            group, size = [], 0
        if len(raw) >= BLOCK:
            s = _long_set(raw, words)
            yield s, np.array([len(s)])
            continue
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield of(group)


def prefix_size_col(n: str, percent: int = PERCENT):
    return F.col(n) - F.ceil(F.lit(percent) * F.col(n) / 100) + 1


def prefix_size(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _signatures(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: sums of its members mixed in two ways."""
    out = []
    for h in (_mix(flat), _mix(flat ^ _BASE)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))[ends]
        out.append(np.diff(sums, prepend=np.uint64(0)).view(np.int64))
    return out[0], out[1]


def _parities(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SKETCH longs of each sorted set: a bit is set if an odd number of members fall on it.

    A member flips one bit, so the sketches of two sets differ in no more bits
    than the sets differ in members.
    """
    sizes = np.diff(ends, prepend=0)
    flips = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << ((flat >> np.uint64(55)) & np.uint64(63)))))
    at = np.repeat(np.arange(len(ends)) * SKETCH, sizes) + (flat >> np.uint64(61)).astype(np.int64)
    upto = flips[np.cumsum(np.bincount(at, minlength=SKETCH * len(ends)))]
    out = upto.copy()
    out[1:] ^= upto[:-1]
    return out.view(np.int64).reshape(-1, SKETCH)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (slots - 1)


def _survey(texts: DataFrame, words: int, slots: int) -> DataFrame:
    """Rows (doc_id, n, a, b, p0, p1, ...) of all documents, p being the sketch, and each task's shingle counts as rows (chunk, task, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting = np.zeros(slots, np.int64), []
        for b in batches:
            n, x, y, sketch = [], [], [], [np.zeros((0, SKETCH), np.int64)]
            for flat, ends in shingle_sets(_slices(b.column(1)), words):
                waiting.append(_slot(flat, slots))
                if sum(map(len, waiting)) > slots:
                    counts += np.bincount(np.concatenate(waiting), minlength=slots)
                    waiting = []
                p, q = _signatures(flat, ends)
                n.append(np.diff(ends, prepend=0))
                x.append(p)
                y.append(q)
                sketch.append(_parities(flat, ends))
            k = b.num_rows
            if k:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(c)) for c in (n, x, y)], *[pa.array(c) for c in np.concatenate(sketch).T.copy()], pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        for w in waiting:
            counts += np.bincount(w, minlength=slots)
        task, part = TaskContext.get().partitionId(), slots // CHUNKS
        for c in range(CHUNKS):
            if (own := counts[c * part : (c + 1) * part]).any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * (4 + SKETCH), pa.array([c], pa.int32()), pa.array([task], pa.int32()), pa.array([own.astype("<u4").tobytes()], pa.binary())], names)

    longs = ["doc_id", "n", "a", "b", *[f"p{i}" for i in range(SKETCH)]]
    names = [*longs, "chunk", "task", "counts"]
    return mapped(texts, run, ", ".join(f"{c} long" for c in longs) + ", chunk int, task int, counts binary")


def _table(survey: DataFrame, slots: int) -> np.ndarray:
    """The counts of all tasks added up, in two levels; ``slots`` numbers reach the driver."""

    def add(kind: str):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), kind).astype(np.int64) for x in t["counts"])
            return pa.table({"chunk": [t["chunk"][0].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

        return run

    parts = survey.filter("chunk IS NOT NULL").select("chunk", (F.col("task") % 64).alias("lot"), "counts")
    first = parts.groupBy("chunk", "lot").applyInArrow(add("<u4"), "chunk int, counts binary")
    out = np.zeros(slots, np.int64)
    for r in first.groupBy("chunk").applyInArrow(add("<i8"), "chunk int, counts binary").collect():
        part = slots // CHUNKS
        out[r["chunk"] * part : (r["chunk"] + 1) * part] = np.frombuffer(r["counts"], "<i8")
    return out


def _sent(texts: DataFrame, table: np.ndarray):
    """The table of counts as a broadcast of 4 bytes a slot."""
    return texts.sparkSession.sparkContext.broadcast(np.minimum(table, 2**32 - 1).astype(np.uint32))


def _seconds(texts: DataFrame, table: np.ndarray, words: int, percent: int) -> DataFrame:
    """(node, token): the shingles that follow each document's prefix in the common order, as many as two linked sets of its size with one prefix share one of."""
    shared = _sent(texts, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            at = 0
            for flat, ends in shingle_sets(_slices(batch.column(1)), words):
                start, found = 0, []
                for end in ends:
                    own = flat[start:end]
                    n, p = len(own), prefix_size(len(own), percent)
                    both = -(-2 * percent * n // (100 + percent))  # least intersection of two linked sets of n
                    order = np.argsort(counts[_slot(own, len(counts))], kind="stable")[p : n - both + 1 + p] if n else []
                    found.append(own[order])
                    start = end
                nodes = np.repeat(np.arange(at, at + len(ends)), [len(f) for f in found])
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(nodes)), pa.array(np.concatenate(found).view(np.int64))], ["node", "token"])
                at += len(ends)

    return mapped(texts, run, "node long, token long")


def _prefixes(texts: DataFrame, table: np.ndarray, words: int, percent: int) -> DataFrame:
    """(a, b, n, gid, prefix) of the classes; a task gives each of its classes once."""
    shared = _sent(texts, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            for flat, ends in shingle_sets(_slices(batch.column(1)), words):
                a, b = _signatures(flat, ends)
                weight = counts[_slot(flat, len(counts))]
                firsts, rows, start = [], [], 0
                for k, end in enumerate(ends):
                    if end > start and (sig := (a[k], b[k])) not in seen:
                        seen.add(sig)
                        order = np.argsort(weight[start:end], kind="stable")[: prefix_size(end - start, percent)]
                        firsts.append(flat[start:end][order])
                        rows.append((k, end - start))
                    start = end
                if rows:
                    at, n = (np.array(c) for c in zip(*rows, strict=True))
                    every, stops = np.concatenate(firsts), np.cumsum([len(f) for f in firsts])
                    g = (_signatures(every, stops)[0].view(np.uint64) * _BASE + n.astype(np.uint64)).view(np.int64)
                    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(every.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(n), pa.array(g), listed], ["a", "b", "n", "gid", "prefix"])

    return mapped(texts, run, "a long, b long, n long, gid long, prefix array<long>")


def _shared(prefixes: DataFrame) -> DataFrame:
    """(token, gid, pos) of prefix shingles that more than one group has; pos: place in the prefix.

    The rows are sorted by (token, gid) over all partitions, so even one shingle
    in a third of all prefixes is dealt to many tasks, and each row looks at its
    neighbours. At a partition's two ends the neighbour isn't seen: such rows
    are kept; what turns out to be alone meets nothing later.
    """
    pairs = prefixes.select(F.posexplode("prefix").alias("pos", "token"), "gid").select("token", "gid", "pos")
    parts = shuffle_parts(prefixes.sparkSession)
    ordered = pairs.repartitionByRange(parts, "token", "gid").sortWithinPartitions("token", "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the token at a batch's end wait for the next batch, two at least: a first and a second group
        names, waiting, first = ["token", "gid", "pos"], None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns]
            rows = [np.concatenate(c) for c in zip(waiting, new, strict=True)] if waiting else new
            first = rows[0][0] if first is None else first
            fresh = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
            rows = [c[fresh] for c in rows]
            t = rows[0]
            twin = np.concatenate(([False], t[1:] == t[:-1]))
            many = twin | np.concatenate((twin[1:], [False])) | (t == first)
            open_ = t == t[-1]
            out = many & ~open_
            if np.count_nonzero(open_) > 2:  # surely shared: all but the last two rows can go on
                ahead = np.nonzero(open_)[0][:-2]
                out[ahead] = True
                open_[ahead] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in rows], names)
            waiting = [c[open_] for c in rows]
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in waiting], names)

    return mapped(ordered, run, "token long, gid long, pos int")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for flat, ends in shingle_sets(_slices(b.column(1)), words):
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), listed], ["node", "shingles"])
                at += len(ends)

    return mapped(texts, run, "node long, shingles array<long>")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its counted rows of two longs are within BROADCAST bytes."""
    return F.broadcast(df) if df.count() * 16 <= BROADCAST else df


def _close(pairs: DataFrame, survey: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sketches differ in no more bits than linked sets of their sizes may.

    No link is lost. A row of ``survey`` for each repeated doc_id is met.
    """
    bits = [f"p{i}" for i in range(SKETCH)]
    x, y = (survey.select(F.col("doc_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", *bits)]) for k in "xy")
    pairs = materialize(pairs, "candidates")
    hot = hot_keys(pairs, "y", pairs.count())
    met = x.join(_small(dealt(pairs, "y", "x", hot)), "x").join(copied(y, "y", hot), ["y", "_slice"])
    differ = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in bits), F.lit(0))
    return met.filter(differ <= F.col("n_x") + F.col("n_y") - 2 * _need("n_x", "n_y", percent)).select("x", "y").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) of documents whose sets have 100 * intersection >= percent * union.

    Sets are computed anew, from the whole texts of the pairs' documents only.
    Only the sets of x travel with their pairs; those of y travel once each, or
    once a slice of a y with very many pairs.
    """
    pairs = materialize(pairs, "pairs")
    hot = hot_keys(pairs, "y", pairs.count())
    side = {}
    for k in "xy":
        ids = _small(pairs.select(F.col(k).alias("doc_id")).distinct())
        side[k] = _sets(texts.join(ids, "doc_id", "left_semi"), words).select(F.col("node").alias(k), F.col("shingles").alias(f"_{k}"))
    met = side["x"].join(_small(dealt(pairs, "y", "x", hot)), "x").join(copied(side["y"], "y", hot), ["y", "_slice"])
    j = met.withColumn("_i", F.size(F.array_intersect("_x", "_y")))
    return j.filter(F.col("_i") * 100 >= (F.size("_x") + F.size("_y") - F.col("_i")) * percent).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of links (x, y); comp: the component's smallest node.

    Each round gives a node the least label among its own, its neighbours' and
    the label of its label, so labels travel in doubling steps. Nodes of many
    links and labels of many nodes are dealt to several tasks.
    """
    ends = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    both = materialize(links.select(ends.alias("e")).select("e.*"), "links")
    old, labels = None, materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "labels")
    n_links, n_nodes = both.count(), labels.count()
    while True:
        near = sliced_join(both, labels.select(F.col("node").alias("y"), "comp"), "y", "x", n_links).groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = sliced_join(labels, up, "comp", "node", n_nodes).join(near, "node").select("node", F.least("comp", "up", "near").alias("new"), "comp")
        new = materialize(new, "labels")
        discard(old if old is not None else labels)
        if not new.filter("new <> comp").limit(1).count():
            discard(both)
            return new.select("node", "comp")
        old, labels = new, new.select("node", F.col("new").alias("comp"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    component_id: the smallest doc_id reachable over links between sets of at
    least ``percent`` / 100 Jaccard similarity. A null, empty or blank text has
    an empty set and is linked with nothing. Equal texts are linked; so are
    repeated rows, which keep a row each. Rows that share a doc_id are one node
    of the links, whatever their texts (``keep_first`` tells them apart). A null
    doc_id is no node: such a row has its class's smallest doc_id, or null. Very
    long texts are hashed a block at a time; one set is in memory at once.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slots = 1 << min(max(texts.count().bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    survey = materialize(_survey(texts, words, slots), "survey")
    rows = survey.filter("chunk IS NULL").select("doc_id", "n", "a", "b")
    classes = materialize(rows.filter("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("node")), "classes")
    table = _table(survey, slots)
    prefixes = materialize(_prefixes(texts, table, words, percent), "prefixes")
    # a class may have come from several tasks; its node is one
    members = materialize(prefixes.select("a", "b", "n", "gid").distinct().join(classes, ["a", "b", "n"]).select("gid", "node", "n"), "members")
    shared = materialize(_shared(prefixes), "shared")
    heads = materialize(members.groupBy("gid").agg(F.min("node").alias("head"), F.first("n").alias("n"), F.count("*").alias("size")), "heads")

    own = members.join(heads.filter("size > 1").select("gid", "head"), "gid").filter("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    alone = shared.join(heads.select("gid", "n", F.col("head").alias("node")), "gid")
    sketched = survey.filter("chunk IS NULL")
    links = materialize(verified(_close(_stars(alone, percent).union(own), sketched, percent), texts, words, percent), "stars")
    labels = components(links)
    named = _named(members, labels)
    pairs = _across(shared, named, percent).union(_inside(named, texts, table, words, percent)).distinct()
    late = materialize(verified(_close(pairs, sketched, percent), texts, words, percent), "across")
    if late.limit(1).count():
        labels = components(links.union(late))
    final = classes.join(labels, "node", "left").select("a", "b", "n", F.coalesce("comp", "node").alias("comp"))
    out = rows.join(final, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their components; a node without links is its own."""
    return materialize(members.join(labels, "node", "left").select("gid", "node", "n", F.coalesce("comp", "node").alias("comp")), "named")


def _live(shared: DataFrame, named: DataFrame) -> DataFrame:
    """(token, gid, pos, n, comp) of the shingles that more than one component has.

    A group's members in one component are one row.
    """
    parts = named.groupBy("gid", "comp").agg(F.first("n").alias("n"))
    part = materialize(shared.join(parts, "gid"), "tokens")
    split = part.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return materialize(part.join(split, "token", "left_semi"), "live")


def _need(n_x: str, n_y: str, percent: int):
    """Least intersection of two sets of these sizes that are linked."""
    return F.ceil(F.lit(percent) * (F.col(n_x) + F.col(n_y)) / (100 + percent))


def _band(n: str, percent: int):
    """Number of a size's band; the sizes of linked sets are in one band or in two that touch (a little wider, so that no rounding matters)."""
    return F.floor(F.log(F.col(n).cast("double")) / (F.log(F.lit(100.0 / min(percent, 99))) * 1.0001)).cast("int")


def _stars(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs of a node and, of the stars of its shingles, the one that it shares most shingles with.

    ``heads``: (token, pos, n, node). A shingle's stars of one band of sizes are
    the node that has it earliest in its prefix and DRAWS nodes drawn by a hash
    of (node, draw); they are met in their own band and in the next.
    """
    live = heads.select("token", "node", "n", "pos", _band("n", percent).alias("band"))
    rank = [F.col("pos").cast("long"), *[F.xxhash64("node", F.lit(d)) for d in range(DRAWS)]]
    tops = live.groupBy("token", "band").agg(*[F.min(F.struct(by.alias("by"), F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("pos").alias("p_y"))).alias(f"s{d}") for d, by in enumerate(rank)])
    stars = F.array_distinct(F.array(*[F.struct(*[F.col(f"s{d}.{c}").alias(c) for c in ("y", "n_y", "p_y")]) for d in range(len(rank))]))
    tops = tops.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), stars.alias("stars"))
    met = live.join(tops, ["token", "band"]).select("node", "n", "pos", F.explode("stars").alias("s")).select("node", "n", "pos", "s.*")
    met = met.filter("node <> y").withColumn("_need", _need("n", "n_y", percent)).filter("n >= _need AND n_y >= _need")
    met = met.groupBy("node", "n", "y").agg(F.count("*").alias("c"), F.max(F.expr("pos <= n - _need AND p_y <= n_y - _need")).alias("ok"))
    best = met.filter("ok").groupBy("node", "n").agg(F.max(F.struct("c", "y")).alias("m")).filter(F.col("m.c") * STAR_SHARE >= prefix_size_col("n", percent))
    return best.select(F.col("node").alias("x"), F.col("m.y").alias("y"))


def _across(shared: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that may reach the threshold.

    Linked sets have a shingle in common that stands in both orders before the
    last need - 1, need being the least intersection for their sizes. For the
    smaller of the two sets that is a short piece of its prefix. Those of one
    group are left to ``_inside``.
    """
    live = _live(shared, named).select("token", "gid", "comp", "n", "pos").withColumn("band", _band("n", percent))
    x, y = (live.select("token", "band", *[F.col(c).alias(f"{c}_{k}") for c in ("gid", "comp", "n", "pos")]) for k in "xy")
    x = x.filter(F.col("pos_x") <= F.col("n_x") - _need("n_x", "n_x", percent)).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    need = _need("n_x", "n_y", percent)
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("comp_x") < F.col("comp_y")))
    met = x.join(y, ["token", "band"]).filter((F.col("gid_x") != F.col("gid_y")) & (F.col("comp_x") != F.col("comp_y")) & once & (F.col("pos_x") <= F.col("n_x") - need) & (F.col("pos_y") <= F.col("n_y") - need))
    pairs = materialize(met.select("gid_x", "comp_x", "gid_y", "comp_y").distinct(), "groups")
    p, q = (named.select(F.col("gid").alias(f"gid_{k}"), F.col("comp").alias(f"comp_{k}"), F.col("node").alias(k)) for k in "xy")
    return pairs.join(p, ["gid_x", "comp_x"]).join(q, ["gid_y", "comp_y"]).select("x", "y")


def _inside(named: DataFrame, texts: DataFrame, table: np.ndarray, words: int, percent: int) -> DataFrame:
    """Pairs of nodes of one group and different components that may reach the threshold.

    They share their whole prefix of p shingles, so what follows it, n - p
    shingles, must have need - p in common: the group is split by the first
    shingles of that rest, of which linked sets share one.
    """
    several = named.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("gid")
    members = materialize(named.join(several, "gid", "left_semi"), "several")
    own = texts.join(_small(members.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")
    tokens = _seconds(own, table, words, percent).distinct().join(members.select("gid", "node", "comp"), "node")
    p, q = (tokens.select("gid", "token", F.col("node").alias(k), F.col("comp").alias(f"c_{k}")) for k in "xy")
    return p.join(q, ["gid", "token"]).filter("c_x < c_y").select("x", "y")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest doc_id.

    Documents without shingles all stay. Where doc_ids are null or repeated, rows
    are told apart by a number in the order of (doc_id, hash of the text), so
    two texts under one doc_id are two documents, and of repeated rows one stays.
    """
    ids = docs.groupBy(F.col(doc_id).alias("d")).count().filter("d IS NULL OR count > 1")
    if ids.limit(1).count():
        cols = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
        rows = docs.select(*cols, F.col(doc_id).alias("_d"), F.xxhash64(F.col(text)).alias("_h"), F.lit(1).cast("long").alias("_one"))
        key = [F.col("_d").asc_nulls_last(), F.col("_h")]
        rows = materialize(exclusive_prefix(range_ordered(rows, *key, label="rows"), "_part", key, "_one", "_row"), "numbered")
        kept = _kept(rows, "_row", f"_c{docs.columns.index(text)}", options)
        return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return _kept(docs, doc_id, text, options)


def _kept(docs: DataFrame, doc_id: str, text: str, options: dict) -> DataFrame:
    out = materialize(near_duplicates(docs, doc_id=doc_id, text=text, **options), "classes-out")
    gone = out.filter("component_id < doc_id").select(F.col("doc_id").alias(doc_id))
    return docs.join(_small(gone), doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
