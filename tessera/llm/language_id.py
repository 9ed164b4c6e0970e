"""Language identification as inference of a multilingual mixture.

Each language is a distribution over hashed character trigrams of letters and
word bounds. A document's trigrams are drawn from a mixture of languages;
expectation-maximisation estimates its proportions, and the set of languages is
chosen by penalised likelihood: a language is added only if the gain in
log-likelihood, scaled to independent trigrams, exceeds the BIC penalty.

Learning reads all labelled rows or, given a bound, a sample of about that many
rows a language picked by a hash of doc_id; counts are added up by Spark.
Prediction is one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

BUCKETS = 1 << 16
#: Characters of a text that are counted at once.
BLOCK = 1 << 18
#: Expected number of labelled rows a language that a model is learnt from.
SAMPLE_PER_LANG = 4000
#: Least proportion of a language in a document's set.
LEAST_SHARE = 0.1
#: Successive trigrams overlap: this share of them counts as independent.
INDEPENDENT = 1 / 3


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(buckets of the trigrams, how often each stands or null for once, number of letters) of the lower-cased text.

    Runs of anything but letters count as one bound; so do the text's ends. A
    text longer than BLOCK is counted a block at a time.
    """
    if len(text) <= BLOCK:
        h, _, n = _grams(text, np.zeros(1, np.uint32), True)
        return (h, None, n) if n else (h[:0], None, 0)
    counts, letters, tail = np.zeros(BUCKETS, np.int64), 0, np.zeros(1, np.uint32)
    for at in range(0, len(text), BLOCK):
        h, tail, n = _grams(text[at : at + BLOCK], tail, at + BLOCK >= len(text))
        counts += np.bincount(h, minlength=BUCKETS)
        letters += n
    seen = np.nonzero(counts)[0] if letters else np.zeros(0, np.int64)
    return seen, counts[seen], letters


def _grams(text: str, tail: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket of each trigram, the two characters that the next block goes on from, number of letters) of a block after ``tail``."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 0)
    n = int(np.count_nonzero(c))
    c = np.concatenate((tail, c, [0] if last else [])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    h = c[:-2] * np.uint32(2654435761) ^ c[1:-1] * np.uint32(2246822519) ^ c[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(668265263) >> np.uint32(16)).astype(np.int64), c[-2:], n


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # languages x BUCKETS

    def __post_init__(self) -> None:
        # by trigram: a trigram's probabilities lie together
        self.p = np.ascontiguousarray(np.exp(self.log_p).T.astype(np.float32))
        self.log_t = np.ascontiguousarray(self.log_p.T.astype(np.float32))


def learn(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_lang: int | None = SAMPLE_PER_LANG, smoothing: float = 0.5) -> Model:
    """Fit on the rows with text and lang; the driver receives at most BUCKETS counts a language."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    if sample_per_lang:
        n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        big = {k: sample_per_lang / v for k, v in n.items() if v > sample_per_lang}
        if big:
            share = F.coalesce(F.create_map(*[F.lit(x) for k, v in sorted(big.items()) for x in (k, v)])[F.col("lang")], F.lit(1.0))
            rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for t, x in zip(b.column(0), b.column(1), strict=True):
                g, times, n = trigrams(t.as_py())
                if n:
                    k = x.as_py()
                    seen[k] = seen.get(k, 0) + np.bincount(g, times, minlength=BUCKETS).astype(np.int64)
        for k, v in seen.items():
            at = np.nonzero(v)[0]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["lang", "bucket", "n"])

    counted = mapped(rows.select("text", "lang"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    c = np.zeros((len(langs), BUCKETS))
    for i, k in enumerate(langs):
        own = counted[counted["lang"] == k]
        c[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    c += smoothing
    return Model(langs, np.log(c / c.sum(1, keepdims=True)) if langs else c)


def _em(p: np.ndarray, times: np.ndarray | None) -> np.ndarray:
    """Proportions of the mixture of the rows of ``p`` (languages x trigrams, each standing ``times``).

    The likelihood is concave in the proportions and no round lowers it, so the
    rounds end; they do once none moves by a thousandth, or once all but one
    language are far below the least share.
    """
    pi, n = np.full(len(p), 1 / len(p)), p.shape[1] if times is None else times.sum()
    while True:
        w = pi[:, None] * p
        w /= w.sum(0)
        new = (w.sum(1) if times is None else (w * times).sum(1)) / n
        done = np.abs(new - pi).max() < 1e-3 or np.sort(new)[-2] < LEAST_SHARE / 2
        pi = new
        if done:
            return pi


def infer(model: Model, grams: np.ndarray, times: np.ndarray | None = None) -> list[tuple[str, float]]:
    """The chosen languages and their proportions, largest first (ties by name).

    The best single language comes first; the others are tried in the order of
    their proportions among all, and one that isn't worth its penalty is passed
    over.
    """
    if len(model.langs) == 1:
        return [(model.langs[0], 1.0)]
    each = 1 if times is None else times[:, None]
    alone = (model.log_t[grams] * each).sum(0, dtype=np.float64)
    chosen, pi, fit = [int(alone.argmax())], np.ones(1), float(alone.max())
    p = np.ascontiguousarray(model.p[grams].T)
    full, n = _em(p, times), len(grams) if times is None else int(times.sum())
    for k in np.argsort(-full, kind="stable"):
        if k in chosen or full[k] < LEAST_SHARE:
            continue
        trial = [*chosen, int(k)]
        share = _em(p[trial], times)
        logs = np.log((share[:, None] * p[trial]).sum(0))
        gain = float(logs.sum() if times is None else (logs * times).sum()) - fit
        if share.min() >= LEAST_SHARE and gain * INDEPENDENT > 0.5 * np.log(n):
            chosen, pi, fit = trial, share, fit + gain
    return sorted(((model.langs[k], float(x)) for k, x in zip(chosen, pi, strict=True)), key=lambda r: (-r[1], r[0]))


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, languages) of each row; ``keep``: after all columns of ``docs``.

    lang_pred: the language with the largest proportion, ``score`` its
    proportion. ``und`` with score 0 for a null text, one without a letter, or if
    nothing was learnt. Rows are handled each on its own; whole texts are read, a
    block at a time. Null doc_ids and repeated rows are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    languages = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = []
            for t in b.column(b.num_columns - 1):
                g, times, n = trigrams(t.as_py() or "")
                found.append(infer(m, g, times) if n and m.langs else [("und", 0.0)])
            out = [pa.array([f[0][0] for f in found], pa.string()), pa.array([f[0][1] for f in found], pa.float64()), pa.array([[{"lang": a, "share": s} for a, s in f] for f in found], languages)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*b.schema.names[:-1], "lang_pred", "score", "languages"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")] if keep else []
    given = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text).alias("_text_read")) if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_read"))
    schema = given.schema[:-1].add("lang_pred", "string").add("score", "double")
    from pyspark.sql import types as T

    schema = schema.add("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))
    return mapped(given, run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the decimal doc_id is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
