"""Site-relative line dedup.

For each host, count the pages that contain a line and divide by the host's
pages; a line above the boilerplate ratio is dropped from that host's pages.

Plan. A page's distinct lines are found inside its row, so one shuffle of
(host, line key) counts, summed map-side first, gives the frequencies: a line
that every page of a hot host has reaches the reducers once a map task. Lines
travel as a 128-bit key, not as text. The host's page total meets the counts
by host, the hottest hosts' over a salted key. A host has at most (mean distinct lines a page) / ratio
boilerplate lines, so each host's keys fit an array; the arrays are broadcast
if their counted size is within ``broadcast_bytes``, else joined by host in the
same way. Texts are never shuffled in the first case and once in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: What is stripped off both ends of a line before it is compared.
BLANKS = " \t\r\f\x0b"
SALTS = 64


def _trimmed(line: str) -> str:
    return f"trim(BOTH ' \\t\\r\\f\\u000b' FROM {line})"


def _key(line: str) -> str:
    """128 bits of the trimmed line: two differently seeded 64-bit hashes."""
    return f"struct(xxhash64({_trimmed(line)}) AS a, xxhash64(1, {_trimmed(line)}) AS b)"


def boilerplate_lines(docs: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """(host, key, line_pages, host_pages) of each line on more than ``ratio`` of its host's pages.

    A line also needs ``min_pages`` pages, so that a host of one or two pages
    loses nothing. Lines are split at line feeds and compared without blanks at
    their ends; blank lines are never boilerplate. A line counts once a page. A
    null host is a host of its own; a null text is a page without lines; each
    repeated row is a page. A page's lines are arrays inside its row, however
    long it is.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    distinct = f"array_distinct(transform(filter(split(text, '\\n'), l -> {_trimmed('l')} <> ''), l -> {_key('l')}))"
    counts = pages.select("host", F.explode(F.expr(distinct)).alias("key")).groupBy("host", "key").agg(F.count("*").alias("line_pages")).filter(F.col("line_pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    hot = _hot_hosts(pages)
    c, t = _dealt(counts, hot, F.col("key.a")), _copied(totals.select(F.col("host").alias("_host"), "host_pages"), "_host", hot)
    joined = c.join(t, c["host"].eqNullSafe(t["_host"]) & (c["salt"] == t["_salt"]))
    return joined.filter(F.col("line_pages") > F.col("host_pages") * F.lit(ratio)).select("host", "key", "line_pages", "host_pages")


def _hot_hosts(pages: DataFrame) -> DataFrame:
    """(_hot, _is) of the hosts with over 1 / SALTS of all pages, of which there are fewer than SALTS; to be broadcast."""
    counts = pages.groupBy(F.col("host").alias("_hot")).agg(F.count("*").alias("_n"))
    return F.broadcast(counts.filter(F.col("_n") * SALTS > pages.count()).select("_hot", F.lit(True).alias("_is")))


def _dealt(rows: DataFrame, hot: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``salt``: those of a hot host are dealt out by a hash."""
    j = rows.join(hot, rows["host"].eqNullSafe(hot["_hot"]), "left")
    return j.withColumn("salt", F.when(F.col("_is"), F.pmod(by, F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot", "_is")


def _copied(hosts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """A row a host, of a hot host one for each salt."""
    j = hosts.join(hot, hosts[key].eqNullSafe(hot["_hot"]), "left")
    return j.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_is"), SALTS - 1).otherwise(0)))).drop("_hot", "_is")


def drop_boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3, broadcast_bytes: int = 8 << 20, report: bool = False) -> DataFrame:
    """``docs`` without the boilerplate lines of each host (see ``boilerplate_lines``).

    All columns and rows stay; ``text`` holds the kept lines joined by line
    feeds (unchanged where nothing is dropped; empty where every line is; null
    where it was null). ``report``: also (n_lines, n_dropped), replacing columns
    of these names.
    """
    lines = materialize(boilerplate_lines(docs, text=text, host=host, ratio=ratio, min_pages=min_pages), "boilerplate")
    small = lines.count() * 64 <= broadcast_bytes
    sets = lines.groupBy(F.col("host").alias("_h")).agg(F.collect_list("key").alias("_set"))
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"), F.col(text).alias("t"))
    if small:
        rows = rows.join(F.broadcast(sets), rows["host"].eqNullSafe(sets["_h"]), "left")
    else:
        hot = _hot_hosts(docs.select(F.col(host).alias("host")))
        rows, spread = _dealt(rows, hot, F.xxhash64(f"row.`{doc_id}`")), _copied(sets, "_h", hot)
        rows = rows.join(spread, rows["host"].eqNullSafe(spread["_h"]) & (rows["salt"] == spread["_salt"]), "left")
    # the page's own boilerplate by a hash set first, so that its lines aren't held against all of its host's
    hits = f"array_intersect(transform(split(t, '\\n'), l -> xxhash64({_trimmed('l')})), transform(_set, k -> k.a))"
    rows = rows.withColumn("_own", F.expr(f"CASE WHEN _set IS NOT NULL AND t IS NOT NULL THEN {let('hit', hits, 'IF(size(hit) = 0, NULL, filter(_set, k -> array_contains(hit, k.a)))')} END"))
    rows = rows.withColumn("kept", F.expr(f"IF(_own IS NULL, NULL, filter(split(t, '\\n'), l -> {_trimmed('l')} = '' OR NOT array_contains(_own, {_key('l')})))"))
    clean = F.coalesce(F.array_join("kept", "\n"), F.col("t"))
    cols = [clean.alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if not (report and c in ("n_lines", "n_dropped"))]
    if report:
        n = F.coalesce(F.size(F.split("t", "\n")), F.lit(0)).cast("long")
        n = F.when(F.col("t").isNull(), F.lit(0).cast("long")).otherwise(n)
        cols += [n.alias("n_lines"), F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).cast("long").alias("n_dropped")]
    return rows.select(*cols)
