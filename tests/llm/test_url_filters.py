import numpy as np
import pytest

from stmtflow.llm import url_filters as uf
from tests.llm.helpers import stored

SCHEMA = "page_id long, url string, html string"


def judged(spark, tmp_path, rows, **more):
    pages = stored(spark, tmp_path, rows, SCHEMA, "pages")
    return {(r.page_id, r.url): r for r in uf.judge_urls(pages, **more).collect()}


def test_rules_and_parts(spark, tmp_path):
    urls = {
        "https://a.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com?q=/de/://b.org/": ("x.com", "", None, "allow"),
        "x://ÄB.com/FR/": ("Äb.com", "/FR/", None, "allow"),
        "no scheme.org/es/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    got = judged(spark, tmp_path, [(i, u, None) for i, u in enumerate(urls)])
    assert {u: (r.host, r.path, r.rule, r.verdict) for (_, u), r in got.items()} == urls


def test_repeated_rows_extra_columns_and_nothing(spark, tmp_path):
    rows = [(1, "http://a.com/de/", "<a href=//b.com>"), (1, "http://a.com/de/", "<a href=//b.com>"), (None, None, None)]
    pages = stored(spark, tmp_path, [(*r, "h", "v") for r in rows], SCHEMA + ", host string, kind string", "pages")
    out = uf.judge_urls(pages)
    assert out.count() == 3 and "kind" in out.columns and {r.host for r in out.collect()} == {"a.com", ""}
    assert uf.judge_urls(pages.where("false")).count() == 0


def test_spread_equals_matrix_powers(spark):
    rng = np.random.default_rng(1)
    n = 12
    links = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(links, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]], "source string, target string, links long")
    seeds = [("trust", "h0", 5.0), ("trust", "h3", 1.0), ("distrust", "h7", 4.0), ("distrust", "alone", 2.0)]
    got = {(r.kind, r.host): r["rank"] for r in uf.spread(edges, spark.createDataFrame(seeds, "kind string, host string, rank double")).collect()}
    for kind, m in (("trust", links), ("distrust", links.T)):
        out = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        s = np.array([sum(x for k, h, x in seeds if k == kind and h == f"h{i}") for i in range(n)])
        r = s
        for _ in range(uf.STEPS):
            r = (1 - uf.DAMPING) * s + uf.DAMPING * r @ out
        for i in range(n):
            assert got.get((kind, f"h{i}"), 0.0) == pytest.approx(r[i], abs=1e-9)
    assert got["distrust", "alone"] == pytest.approx(2 * (1 - uf.DAMPING))


def test_distrust_follows_long_chains_and_circles(spark, tmp_path):
    bad = [(i, f"http://{'hk'[i % 2]}0.com/de/{i}", "") for i in range(2000)]
    chain = [(2000 + i, f"http://h{i}.net/", f"<a href='http://h{i - 1}.{'com' if i == 1 else 'net'}/'>x</a>") for i in range(1, 20)]
    circle = [(3000 + i, f"http://c{i}.net/", f"<a href='http://c{(i + 1) % 3}.net/'>x</a>" + "<a href='http://k0.com/'>x</a>" * (i == 0)) for i in range(3)]
    got = judged(spark, tmp_path, bad + chain + circle)
    for i in range(1, 20):
        rank = 1000 * (1 - uf.DAMPING) * uf.DAMPING**i
        assert got[2000 + i, f"http://h{i}.net/"].verdict == ("block" if rank / (rank + uf.GOODWILL) >= uf.THRESHOLD else "allow"), i
    assert {got[3000 + i, f"http://c{i}.net/"].verdict for i in range(3)} == {"block"}


def test_host_that_links_to_blocked_pages_is_blocked(spark, tmp_path):
    bad = [(i, f"http://bad.com/de/{i}", "") for i in range(300)]
    farm = [(1000 + i, f"http://farm.net/{i}", '<A HREF="https://bad.com/de/1">x</a> <a href="/local">') for i in range(5)]
    fine = [(2000 + i, f"http://fine.net/{i}", "<a href='http://good.org/'>x</a>") for i in range(5)]
    good = [(3000 + i, f"http://good.org/{i}", "<img src=//fine.net/i.png>") for i in range(50)]
    got = judged(spark, tmp_path, bad + farm + fine + good)
    verdict = {h: {r.verdict for r in got.values() if r.host == h and r.rule is None} for h in ("farm.net", "fine.net")}
    assert verdict == {"farm.net": {"block"}, "fine.net": {"allow"}}
    assert uf.host_links(spark.createDataFrame([("a.com", "<a href='http://a.com/x'><a href='?x'><a href='mailto:b@c.org'>")], "h string, b string"), "h", "b").count() == 0
