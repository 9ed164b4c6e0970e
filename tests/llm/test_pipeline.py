"""The five stages and run() against plain Python, and on tables of odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language_id, mix
from tessera.session import materialize
from tests.llm.test_jaccard_join import brute
from tests.llm.test_text_ops import EDGE, demand_time, direct_ids, plain_mixture, targets, u32, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_languages(docs):
    counts = defaultdict(lambda: np.zeros(language_id.BUCKETS))
    for i, t, lang, *_ in docs:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            g, times, n = language_id.trigrams(t)
            if n:
                counts[lang] += np.bincount(g, times, minlength=language_id.BUCKETS)
    langs = sorted(counts)
    p = [(counts[k] + 0.5) / (counts[k] + 0.5).sum() for k in langs]
    kept = []
    for r in docs:
        g, _, n = language_id.trigrams(r[1] or "")
        if n and langs:
            share = plain_mixture([x[g].tolist() for x in p], language_id.LEAST_SHARE, language_id.INDEPENDENT)[1] if len(langs) > 1 else [1.0]
            if max(share) >= corpus_pipeline.LEAST_SCORE:
                kept.append(r)
    return kept


def plain_lines(docs):
    trim = lambda x: x.strip(" \t\r\f\v")
    pages, has = Counter(r[3] for r in docs), Counter()
    for r in docs:
        has.update((r[3], x) for x in {trim(x) for x in (r[1] or "").split("\n")} if x)
    bad = {k for k, n in has.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    out = []
    for i, t, lang, source, _ in docs:
        t = None if t is None else "\n".join(x for x in t.split("\n") if (source, trim(x)) not in bad)
        out.append((i, t, lang, source, None if t is None else len(t)))
    return out


def plain_first(docs):
    comp = {i: c for i, _, c in brute([(r[0], r[1]) for r in docs])}
    return [r for r in docs if comp[r[0]] == r[0]]


def plain_mix(docs):
    """Rows in training order, from the targets, the streams in hash order and the inverted schedules."""
    size, per = {r[0]: len(words(r[1])) for r in docs}, defaultdict(list)
    for r in docs:
        per[r[3]].append(r)
    total = {s: sum(size[r[0]] for r in rs) for s, rs in per.items()}
    want = targets(total)
    names = sorted(s for s in per if s is not None) + ([None] if None in per else [])
    out = []
    for k, s in enumerate(names):
        before, demand = 0, int(want[s])
        for r in sorted(per[s], key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r[0])):
            n = size[r[0]]
            if n:
                passes = demand // total[s]
                taken = passes * n + max(0, min(n, demand - passes * total[s] - before))
                copies = taken // n + (2 * (taken % n) >= n)
                for c in range(copies if taken else 0):
                    out.append((demand_time(min((before + c * total[s]) / demand, 1.0), mix.SLOPES[k % 3]), r))
            before += n
    return out


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def pieces_of(docs):
    out = Counter()
    for r in docs:
        ids = direct_ids(r[1] or "") + [0]
        for s in range(0, len(ids), 1024):
            out[(r[0], s, len(ids[s : s + 1024]), zlib.crc32(u32(ids[s : s + 1024])), len(ids))] += 1
    return out


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain, found = as_rows(docs), docs
    for (name, stage), step in zip(corpus_pipeline.STAGES[:3], (plain_languages, plain_lines, plain_first)):
        found, plain = materialize(stage(spark, found, sf), name), step(plain)
        assert found.columns == docs.columns
        assert sorted(as_rows(found), key=repr) == sorted(plain, key=repr), name
    timed = plain_mix(plain)
    found = materialize(corpus_pipeline.mixing(spark, found, sf), "mixing")
    assert Counter(as_rows(found)) == Counter(r for _, r in timed)
    placed = found.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    when = defaultdict(list)
    for t, r in sorted(timed, key=lambda x: x[0]):
        when[r[0]].append(t)
    order = [when[r["doc_id"]].pop(0) for r in sorted(placed, key=lambda r: (r["f"], r["i"]))]
    assert all(x <= y + 1e-6 for x, y in zip(order, order[1:]))
    want = pieces_of(r for _, r in timed)
    for out in (corpus_pipeline.pack(spark, found, sf).collect(), corpus_pipeline.run(spark, sf).collect()):
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
        seqs = defaultdict(list)
        for r in out:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in seqs.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        assert sum(r["length"] for r in out) > 0.9 * 1024 * len(seqs)


ODD = [*EDGE, (None, "no number for this one", "en", "a", 22), (11, "x" * 300_000, "en", "a", 300_000), (10, "another text under one number", None, None, None)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, tmp_path, rows):
    """Nulls in any column, empty and long texts, repeated rows, one doc_id twice, a clashing column; and no rows at all."""
    clash = ["host", "h", "size", "row", "token", "part", "place", "key", "position", "score", "_at"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in clash})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
        assert name == "mixing" or docs.count() <= before
        texts = {r["text"] for r in docs.collect()}
        if rows and name == "jaccard_join":
            assert "no number for this one" in texts and "another text under one number" in texts and "x" * 300_000 in texts
    out = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert (sum(r["length"] for r in out) > 0) == bool(rows)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) == Counter((r["doc_id"], len(direct_ids(r["text"])) + 1) for r in docs.collect())
