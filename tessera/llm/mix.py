"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training run, linear in time.
Integrating it gives the words the run has demanded of the source by a time;
inverting that integral at a document's place in its source's stream gives the
time at which the document is trained on. The result is range-sorted by it.

Plan. Words are counted natively. A source's stream is ordered by a hash of
doc_id; prefix sums over it are taken in two levels (hash ranges, then rows of
a range), so a source that holds a third of all rows is spread over all ranges.
Sources are ranked in ranges too, and the capped targets come from a driver
loop over one aggregate row, not from collected sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, exclusive_prefix, materialize, range_ordered, shuffle_parts

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Slope of the weight schedule of the sources, repeating: a source starts at
#: (1 - slope) of its mean weight and ends at (1 + slope).
SLOPES = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3


def n_words(text: str):
    """Words, as in ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _stream_hash(doc_id: Column) -> Column:
    """60 bits that order a source's stream: the first of the MD5 of the decimal doc_id."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, slope, target) of documents (source, size).

    All sizes together are shared out by weight; a target stops at MAX_EPOCHS
    times its source's size and the excess is shared again by weight among the
    others until none is above. The fixed point is min(cap, level * weight) for
    the one level at which the targets sum to the total; the level only rises
    from round to round, so the loop ends after at most as many rounds as there
    are sources (in practice a few).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = range_ordered(per.withColumn("one", F.lit(1).cast("long")), F.col("source").asc_nulls_last(), label="sources")
    ranked = exclusive_prefix(ordered, "_part", [F.col("source").asc_nulls_last()], "one", "rank")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("rank") % len(xs) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", pick(WEIGHTS).cast("double").alias("weight"), pick(SLOPES).cast("double").alias("slope")), "targets")
    cap, level = F.col("source_size") * MAX_EPOCHS, 0.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        got = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["all"] or not got["open"]:
            break
        higher = (got["all"] - (got["capped"] or 0)) / got["open"]
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _time_of(share, slope):
    """The t in [0, 1] at which the integral of 1 + slope * (2 t - 1) is ``share``."""
    b = F.lit(1.0) - slope
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0)))
    t = F.when(slope == 0, share).otherwise((root - b) / (F.lit(2.0) * slope))
    return F.least(F.abs(t), F.lit(1.0))


def curriculum(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, position, positions), not yet sorted.

    A source's stream repeats its documents in hash order until its target is
    reached: ``taken`` is size times the whole passes, and in the last pass the
    documents up to the demand, the one on the border in part. So a source's
    taken words are its target rounded down, and none exceeds 3 times its size.
    ``positions``: the time of each copy in training, ``position`` that of the
    first; both null where nothing is taken. A null source is a source, sorted last; null or wordless texts have
    size 0 and take nothing; repeated rows are documents of their own, ordered by
    (hash, doc_id, text hash); rows equal in all of these are alike in all but
    the split between them.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), _stream_hash(F.col(doc_id)).alias("h"), F.xxhash64(F.col(text)).alias("th"))
    d = materialize(d, "sizes")
    targets = source_targets(d.select("source", "size"))
    buckets = 4 * shuffle_parts(docs.sparkSession)
    # the hash, as a share of its range, picks the bucket; buckets follow the hash's order
    d = d.withColumn("bucket", F.least(F.floor(F.col("h") / F.lit(2.0**60) * buckets), F.lit(buckets - 1)).cast("int"))
    d = exclusive_prefix(d, "bucket", [F.col("h"), F.col("doc_id"), F.col("th")], "size", "before", within=("source",))
    t = targets.select(F.col("source").alias("_source"), "source_size", "slope", "target", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_salt"))
    d = d.withColumn("_s", F.pmod(F.col("h"), F.lit(64)).cast("int"))
    d = d.join(t, d["source"].eqNullSafe(t["_source"]) & (d["_s"] == t["_salt"]))
    words = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    # whole passes in integers: words / source_size may round up in doubles
    passes = F.when(passes * F.col("source_size") > words, passes - 1).otherwise(passes)
    d = d.withColumn("_words", words).withColumn("_passes", passes)
    rest = F.col("_words") - F.col("_passes") * F.col("source_size") - F.col("before")
    d = d.withColumn("taken", F.col("_passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    # copy c starts c - 1 whole passes of the source after the first one
    copies = F.expr("sequence(1L, CAST(ceil(taken / size) AS BIGINT))")
    place = lambda c: F.least((F.col("before") + (c - 1) * F.col("source_size")) / F.greatest(F.col("_words"), F.lit(1)), F.lit(1.0))
    d = d.withColumn("positions", F.when(F.col("taken") > 0, F.transform(copies, lambda c: _time_of(place(c), F.col("slope")))))
    return d.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions", F.col("th").alias("text_hash"), "source", "before")


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """``curriculum``, range-sorted by training position (documents not taken last)."""
    out = curriculum(docs, **columns).drop("text_hash", "source", "before")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, range-sorted by each copy's own position.

    Texts stay whole: a document that the mix takes in part is, in its last
    copy, taken whole if at least half of it was to be taken, else left out. All
    columns are kept. Whole rows are shuffled twice, to meet their plan and to
    be sorted.
    """
    plan = curriculum(docs, doc_id=doc_id, text=text, source=source).filter("taken > 0")
    whole = F.expr("CAST(taken DIV size + IF(2 * (taken % size) >= size, 1, 0) AS INT)")
    plan = plan.select(*_row_key(F.col("doc_id"), F.col("text_hash"), F.col("source")), F.slice("positions", 1, whole).alias("positions"), "before")
    plan = materialize(plan.filter("size(positions) > 0"), "plan")
    rows = docs.select(F.struct("*").alias("row"), *_row_key(F.col(doc_id), F.xxhash64(F.col(text)), F.col(source)))
    on = ["_id", "_key"]
    if plan.groupBy(*on).count().filter("count > 1").limit(1).count():
        # repeated rows pair off by number: they are alike, so which gets which part doesn't matter
        each = Window.partitionBy(*on)
        plan, rows = plan.withColumn("_n", F.row_number().over(each.orderBy("before"))), rows.withColumn("_n", F.row_number().over(each.orderBy("_key")))
        on = [*on, "_n"]
    j = rows.join(plan, on).select("row", F.explode("positions").alias("_at"))
    return j.orderBy("_at").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _row_key(doc_id: Column, text_hash: Column, source: Column) -> list[Column]:
    """(_id, _key) of a row, without nulls, so that a join on them is a plain one."""
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(text_hash, source, doc_id.isNull()).alias("_key")]
