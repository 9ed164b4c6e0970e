"""URL filters: domain and path rules first, else a logistic regression on
hashed character n-grams of host and path.

The model is trained on the driver from a bounded, documented sample of a
labelled URL table and scored in Arrow batches, a block of characters at a time.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: (rule, verdict); a rule is a host, and all its subdomains, and a path prefix.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
SIZES = (3, 4, 5)
BUCKETS = 1 << 15
#: Characters whose n-grams are held at once.
BLOCK = 1 << 18
#: Rows that the model is fitted on at most, the first by a hash of the url.
SAMPLE = 20_000


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. Both are empty for a null url or one without ``://``."""
    u = F.col(url)
    rest = F.when(u.isNull() | (F.instr(u, "://") == 0), F.lit("")).otherwise(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    pages = pages.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.expr("regexp_extract(substring(_rest, length(regexp_extract(_rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0)")
    return pages.withColumn("host", lowered).withColumn("path", path).drop("_rest")


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits (host, path), null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one, taken later, wins
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(codes: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at each place of ``codes``; ``part`` tells those of hosts from those of paths."""
    k = len(codes) - n + 1
    h = part[:k] * np.uint64(31) + np.uint64(n)
    for i in range(n):
        h = (h ^ codes[i : k + i]) * np.uint64(0x100000001B3)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def features(urls: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every character n-gram of each (host, path), at most about BLOCK characters at a time.

    Host and path are taken apart, each between bounds ``^`` and ``$``.
    """
    codes, rows, part, size = [], [], [], 0

    def of() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, r, p = np.concatenate(codes), np.concatenate(rows), np.concatenate(part)
        own = 2 * r.astype(np.uint64) + p
        for n in SIZES:
            if len(c) >= n:
                inside = own[: len(c) - n + 1] == own[n - 1 :]
                yield r[: len(c) - n + 1][inside], _grams(c, p, n)[inside]

    for k, pair in enumerate(urls):
        for j, text in enumerate(pair):
            c = np.frombuffer(f"^{text}$".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if len(c) > BLOCK:  # alone, in blocks that overlap by less than an n-gram
                for n in SIZES:
                    for at in range(0, len(c) - n + 1, BLOCK):
                        piece = c[at : at + BLOCK + n - 1]
                        h = _grams(piece, np.full(len(piece), j, np.uint64), n)
                        yield np.full(len(h), k), h
                continue
            if size + len(c) > BLOCK:
                yield from of()
                codes, rows, part, size = [], [], [], 0
            codes.append(c)
            rows.append(np.full(len(c), k))
            part.append(np.full(len(c), j, np.uint64))
            size += len(c)
    if codes:
        yield from of()


def _margins(weights: np.ndarray, urls: list[tuple[str, str]]) -> np.ndarray:
    total, n = np.zeros(len(urls)), np.zeros(len(urls))
    for rows, buckets in features(urls):
        total += np.bincount(rows, weights[buckets], minlength=len(urls))
        n += np.bincount(rows, minlength=len(urls))
    return total / np.sqrt(np.maximum(n, 1)) + weights[BUCKETS]


def fit(urls: list[tuple[str, str]], block: np.ndarray, epochs: int = 200, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias by full-batch gradient descent with momentum; no rows: all zero."""
    w = np.zeros(BUCKETS + 1)
    if not urls:
        return w
    rows, buckets = (np.concatenate(x) for x in zip(*features(urls), strict=True))
    x = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(urls)), 1))
    y, speed = block.astype(float), np.zeros_like(w)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[BUCKETS] = np.log(base / (1 - base))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[buckets], minlength=len(urls)) * x + w[BUCKETS])))
        e = (p - y) / len(urls)
        g = np.append(np.bincount(buckets, (e * x)[rows], minlength=BUCKETS), e.sum())
        g[:BUCKETS] += decay * w[:BUCKETS]
        speed = 0.9 * speed - rate * g
        w += speed
    return w


def train(labelled: DataFrame, *, url: str = "url", label: str = "block", sample: int = SAMPLE) -> np.ndarray:
    """Fit on (url, block 0/1); at most ``sample`` rows, by hash of the url. Null labels don't count."""
    rows = with_host_path(labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("block")).filter(F.col("block").isNotNull()))
    rows = rows.select("host", "path", "block").orderBy(F.xxhash64("host", "path"), "host", "path", "block").limit(sample).collect()
    return fit([(r["host"], r["path"]) for r in rows], np.array([r["block"] for r in rows]))


def judge(pages: DataFrame, weights: np.ndarray, *, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    verdict: the longest fitting rule's, else ``block`` where the model's
    probability exceeds 1/2. A null or malformed url has empty host and path and
    is judged by the model. Repeated rows are judged each; no other column of
    ``pages`` is read. Very long urls are scored a block at a time.
    """
    ship_package(pages.sparkSession)
    rows = with_host_path(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rule, says = rule_columns(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            yield pd.Series(1 / (1 + np.exp(-_margins(shared.value, list(zip(host, path, strict=True))))))

    rows = rows.withColumn("block_score", score("host", "path"))
    verdict = F.coalesce("says", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
