"""Document fingerprints from closed syncmers.

A text is a sequence of tokens: words, and the single characters of runs of more
than LONG characters without white space (Chinese or Japanese text, encoded
data). A k-mer is K consecutive tokens; its inner substrings are the K - S + 1
runs of S tokens, ordered by hash. A k-mer is a closed syncmer if its smallest
inner run stands at its first or last place. Whether it is chosen depends on its
own tokens alone, so the same passage gives the same anchors in any document,
and no two neighbouring anchors are more than K - S tokens apart.

The fingerprint is the list of all anchors of the whole text with their places,
each as (tokens since the anchor before) << 32 | (32 bits of the k-mer's hash);
the string has nine hexadecimal digits an anchor. Two fingerprints are matched
by position: a pair of neighbouring anchors counts as shared only if both
anchors and the distance between them are the same. Likeness is the Jaccard
similarity of these pairs.

Everything is array expressions inside one row; there is no Python. Very long
texts are arrays of their tokens in one row: some 50 bytes a token.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, shuffle_parts

K, S = 5, 2
#: Longer runs without white space are taken character by character.
LONG = 16
#: Mask of an anchor's hash in its code.
HASH = 0xFFFFFFFF


def tokens_sql(text: str) -> str:
    """SQL of the array of a text's tokens; null counts as empty."""
    c = f"[^{SPACE}]".replace("\\", "\\\\")
    return f"regexp_extract_all(coalesce({text}, ''), '(?<!{c}){c}{{1,{LONG}}}+(?!{c})|{c}', 0)"


def places_sql(text: str) -> str:
    """SQL of all anchors of ``text`` in order, each as (number of its first token, from 1) << 32 | (32 bits of its hash).

    A text of fewer than K tokens is one anchor, its whole token sequence; so is
    one without a closed syncmer. No tokens (empty, null, blank): no anchor.
    """
    runs = "transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))"
    inner = K - S + 1
    parts = ", ".join(["x", *[f"get(h, i + {j})" for j in (*range(S, K - S, S), K - S)]])  # these runs make up the k-mer
    place = "shiftleft(CAST(i + 1 AS BIGINT), 32)"
    chosen = f"filter(transform(h, (x, i) -> IF(i <= size(h) - {K} AND least(x, get(h, i + {K - S})) = array_min(slice(h, i + 1, {inner})), {place} + shiftrightunsigned(xxhash64({parts}), 32), NULL)), y -> y IS NOT NULL)"
    whole = "array(shiftleft(1L, 32) + shiftrightunsigned(xxhash64(w), 32))"
    several = let("h", runs, let("a", chosen, f"IF(size(a) > 0, a, {whole})"))
    return let("w", tokens_sql(text), f"CASE WHEN size(w) = 0 THEN CAST(array() AS ARRAY<BIGINT>) WHEN size(w) < {K} THEN {whole} ELSE {several} END")


def codes_sql(text: str) -> str:
    """SQL of the fingerprint of ``text`` as an array of longs: its anchors, with distances in place of places."""
    return let("z", places_sql(text), f"transform(z, (x, i) -> x - coalesce(get(z, i - 1), 0L) + (coalesce(get(z, i - 1), 0L) & {HASH}L))")


def as_string(codes: str) -> Column:
    """The fingerprint as hexadecimal digits, nine an anchor: one for the distance, eight for the hash."""
    return F.expr(f"array_join(transform({codes}, x -> hex(x)), '')")


def links_sql(codes: str) -> str:
    """SQL of the hashes of neighbouring anchors with their distance; an anchor without a neighbour stands alone."""
    return f"IF(size({codes}) < 2, transform({codes}, x -> x & {HASH}L), transform(slice({codes}, 1, greatest(size({codes}) - 1, 1)), (x, i) -> xxhash64(x & {HASH}L, get({codes}, i + 1))))"


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' links, 0 to 1; two empty ones are alike (1)."""
    body = "IF(size(array_union(p, q)) = 0, 1.0D, size(array_intersect(p, q)) / size(array_union(p, q)))"
    return F.expr(let("p", links_sql(a), let("q", links_sql(b), body))).cast("double")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, codes, fingerprint) of each row; equal texts get equal fingerprints."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    return d.select("doc_id", F.expr(codes_sql("_t")).alias("codes")).withColumn("fingerprint", as_string("codes"))


def anchors(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, anchor): every anchor of every text and the number of the token at which it starts, from 0."""
    placed = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.expr(places_sql(f"`{text}`"))).alias("place"))
    return placed.select("doc_id", (F.shiftright("place", 32) - 1).alias("position"), F.col("place").bitwiseAND(HASH).alias("anchor"))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) up to ``value``, -1 for null: a search in two steps of sqrt(n) each."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    step = math.isqrt(len(bounds) - 1) + 1
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    group = F.greatest(upto(F.lit(bounds[::step])) - 1, F.lit(0))
    return F.when(value.isNull(), -1).otherwise(group * step + upto(F.slice(F.lit(bounds), group * step + 1, F.lit(step))))


def edit_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness.

    The next document is that of the next smaller doc_id, after the last the
    first. The edited text has the last floor(n_chars / 3) code points replaced
    by the first as many (or all) of the next one's. Null texts count as empty.
    A lone document is its own next. Null doc_ids come last; rows that share a
    doc_id are ordered by the hash of their text.

    Plan: doc_ids are cut into ranges at their quantiles (a number a range
    reaches the driver). Texts are shuffled once, by range; inside a range the
    next row comes from a window, and after a range's last row it is the first
    one of the next range, of which there is one a range. A text's fingerprint is
    taken once, after the shuffle.
    """
    parts = 4 * shuffle_parts(docs.sparkSession)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], min(20 * parts, 1_000_000))).first()[0]
    bucket = _bucket(F.col("doc_id"), sorted(set(cuts or [])))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t")).select("doc_id", bucket.alias("range"), F.xxhash64("t").alias("h"), "t")

    # the first row of each range: a row a range, of two numbers until its text is fetched
    tops = ids.select("doc_id", bucket.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"))
    round_ = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    after = tops.select("range", F.coalesce(F.lead("range").over(round_), F.first("range").over(round_)).alias("after"))
    found = rows.join(F.broadcast(tops.withColumnRenamed("range", "r")), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = found.groupBy("range").agg(F.min(F.struct("h", "t")).alias("m")).select(F.col("range").alias("after"), F.col("m.t").alias("first_t"))
    firsts = after.join(firsts, "after").select("range", "first_t", F.expr(codes_sql("first_t")).alias("first_codes"))

    rows = rows.repartition("range").withColumn("codes", F.expr(codes_sql("t")))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "h")
    rows = rows.withColumn("next", F.lead(F.struct("t", "codes")).over(order))
    rows = rows.join(firsts, "range", "left")
    rows = rows.select("doc_id", "t", "codes", F.length("t").cast("long").alias("n_chars"), F.coalesce("next.t", "first_t").alias("next_t"), F.coalesce("next.codes", "first_codes").alias("next_codes"))
    rows = rows.withColumn("edited", F.expr("concat(substring(t, 1, CAST(n_chars - n_chars DIV 3 AS INT)), substring(next_t, 1, CAST(n_chars DIV 3 AS INT)))"))
    rows = rows.withColumn("edited_codes", F.expr(codes_sql("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string("codes").alias("fingerprint"),
        as_string("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"),
        likeness("codes", "next_codes").alias("near_next"),
    )
