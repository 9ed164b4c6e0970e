"""The Jaccard join against brute force over all pairs."""

import random
import re
from collections import defaultdict

from tessera.llm import jaccard_join, queries
from tessera.llm.jaccard_join import keep_first, near_duplicates
from tests.oracle import assert_same


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    near = {(a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        (i, s), (j, t) = sets[a], sets[b]
        n = len(s & t)
        if 100 * n >= 75 * (len(s) + len(t) - n):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def same(spark, rows):
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, token string, gid int")
    got = [tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == len(rows)
    assert set(got) == brute(rows)


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return w


def test_against_brute_force_on_planted_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [f"c{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(3, 160))
        for c in range(rng.choice([1, 1, 2, 6, 25])):
            w = edited(rng, base, rng.randint(0, max(1, len(base) // 25))) if c else base
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + common + w[at:]
            rows.append((n, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            n += 1
    rng.shuffle(rows)
    same(spark, rows)


def test_one_prefix_and_many_unlinked_documents(spark):
    """Documents whose rarest shingles are the same passage, while the rest tells them apart or makes them near copies."""
    rng = random.Random(11)
    gap = ["s1", "s2", "s3", "s4"]  # no shingle lies in two passages
    rare = [*gap, *[f"r{i}" for i in range(30)], *gap]
    pool = [[*[f"p{k}x{i}" for i in range(35)], *gap] for k in range(14)]
    rows = [(1000 + n, " ".join([*gap, *[w for k in rng.sample(range(14), 3) for w in pool[k]]])) for n in range(300)]
    for n in range(36):
        some = rng.sample(range(14), 2) if n % 3 else [n % 2, 5]
        rows.append((n, " ".join(rare + [w for k in some for w in pool[k]])))
    same(spark, rows)
    # the case is what it is meant to be: groups whose members lie in several components
    texts = spark.createDataFrame([(n, t) for n, t in rows], "doc_id long, text string")
    slots = 1 << 19
    table = jaccard_join._table(jaccard_join._survey(texts, 5, slots), slots)
    groups = defaultdict(set)
    for r in jaccard_join._prefixes(texts, table, 5, 75).collect():
        groups[r["gid"]].add((r["a"], r["b"]))
    assert max(map(len, groups.values())) > 5


def test_edges(spark):
    long = " ".join(f"v{i % 4001} u{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (7, long), (8, long + " end"), (9, "a b c d e"), (10, "a b c d e f"), (11, "a b c d e")]
    same(spark, rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(0, 1, 0), (1, 2, 1), (1, 2, 1)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in keep_first(df).collect()) == [0, 1]
    texts = [(1, "a b c d e", 7), (1, "q r s t u", 8), (2, "q r s t u", 9), (None, "q r s t u", 9), (None, "k", 9), (5, "a B c d e", 1), (5, "m n", 2), (3, None, 3), (3, None, 4), (3, "", 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string, token int")
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([texts[0], texts[1], texts[4], texts[6], *texts[7:]], key=repr)
    assert keep_first(df.limit(0)).count() == 0


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    import numpy as np

    texts = [b"", b" ", b"x" * 64, b"x" * 64 + b" ", b" " + b"x" * 300 + b"  y", b"abc de\n" * 90, b"a" * 63 + b" " + b"b" * 65]
    want = [jaccard_join._word_hashes(t)[1] for t in texts]
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    jaccard_join._powers.cache_clear()
    for t, w in zip(texts, want, strict=True):
        got = np.concatenate([np.zeros(0, np.uint64), *jaccard_join._long_hashes(t)])
        assert len(got) == len(t.split()) and (got == w).all()
    jaccard_join._powers.cache_clear()


def test_documents(spark, sf):
    assert_same(spark, sf, queries.op10_jaccard_join, queries.oracle_sql()["op10_jaccard_join"])


def test_components_of_hubs_chains_and_loops(spark):
    """A star with most of the links, a long chain, a loop and a link to itself, against plain search."""
    links = [(k, 0) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 3000)] + [(-5, 399)]
    near = defaultdict(set)
    for x, y in links:
        near[x].add(y)
        near[y].add(x)
    want = {}
    for v in sorted(near):
        todo = [v] if v not in want else []
        while todo:
            u = todo.pop()
            if u not in want:
                want[u] = v
                todo += near[u]
    df = spark.createDataFrame(links, "x long, y long")
    assert {r["node"]: r["comp"] for r in jaccard_join.components(df).collect()} == want
    assert jaccard_join.components(df.limit(0)).count() == 0
