import numpy as np

from tessera.llm import labelled_urls, queries, url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for rule, says in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return best or (None, None)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "http://a.example.org/en/17", "http://myexample.org/en/17", "http://org", "http://org?x=/", "https://x.com/fr/1?q#f", "https://x.com/de/1", "x://A.Com#/fr/", "a://b://c/d", "http://É.ORG/Ä", "http://x.net/" + "p/" * 5000]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(df, url_filter.fit([], np.zeros(0))).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        rule, says = ruled(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), u
        assert out[i]["verdict"] == (says or "allow")
    assert url_filter.judge(df.limit(0), url_filter.fit([], np.zeros(0))).count() == 0


def test_query(spark, sf):
    out = queries.op3_url_filter(spark, sf).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(out) == len(pages)
    for r in out:
        host, path = split(pages[r["page_id"]])
        rule, says = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (says or ("block" if r["block_score"] > 0.5 else "allow"))


def test_model_learns_held_out_urls(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = [(f"http://{word()}.net/{'casino-win' if k % 3 == 0 else 'article'}/{word()}", k % 3 == 0) for k in range(600)]
    w = url_filter.train(spark.createDataFrame(rows[:400], "url string, block boolean"))
    out = url_filter.judge(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[400:])], "page_id long, url string"), w).collect()
    assert sum((r["verdict"] == "block") == rows[400 + r["page_id"]][1] for r in out) > 195


def test_query_ignores_a_column_named_n(spark, sf, tmp_path):
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    pages.selectExpr("*", "'x' AS n", "-1 AS number").write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scores = lambda d: {r["page_id"]: (r["verdict"], round(r["block_score"], 6)) for r in queries.op3_url_filter(spark, str(d)).collect()}
    assert scores(tmp_path) == scores(sf)


def test_shipped_table_tells_unseen_sites(spark, sf):
    """None of the pages' hosts stands in the labelled table; its spam sites rank above all others."""
    spam = ("casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x")
    assert not set(spam) & {*labelled_urls.BLOCKED, *labelled_urls.ALLOWED}
    out = queries.op3_url_filter(spark, sf.replace("0.001", "0.1")).collect()
    bad, good = ([r["block_score"] for r in out if any(s in r["host"] for s in spam) == k] for k in (True, False))
    auc = np.mean([[b > g for g in good[::5]] for b in bad])
    right = sum(s > 0.5 for s in bad) + sum(s <= 0.5 for s in good)
    assert auc > 0.95 and right / len(out) > 0.98 > len(good) / len(out)


def test_n_grams_do_not_depend_on_the_block(monkeypatch):
    urls = [("", ""), ("a", "/"), ("É.org", "/x" * 90), ("host.example", ""), ("h" * 300, "/p")]
    def every():
        return sorted((int(r), int(b)) for rows, buckets in url_filter.features(urls) for r, b in zip(rows, buckets))
    want = every()
    for block in (8, 50, 200):
        monkeypatch.setattr(url_filter, "BLOCK", block)
        assert every() == want
    host, path = (sorted(int(b) for _, x in url_filter.features([p]) for b in x) for p in (("abc", ""), ("", "abc")))
    assert host != path
