import random

from mediasift.llm import hamming_search, url_filters

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("bad.net", "/", "block"), ("good.net", "/", "allow")]


def judge(spark, urls, links):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in urls], "page_id long, url string, host string, rule string, component string")
    rules = spark.createDataFrame(RULES, "host string, path string, decision string")
    found = url_filters.judge_urls(pages, rules, spark.createDataFrame(links, "source string, target string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


def test_rules_and_equivalence(spark):
    urls = [
        (1, "http://A.Example.ORG/es/1?q#f"), (2, "http://example.org/en/"), (3, "https://x.com/de/9"), (4, "https://x.com"), (5, None), (6, "no host"), (7, ""),
        (8, "http://alias.one/a"), (9, "https://alias.two/b/"), (10, "http://mixed.one/a"), (11, "http://far.one/z"), (12, "http://notorg/"), (13, "ftp://u/://h/?x"), (14, "http://alias.two/b#top"),
    ]
    links = [
        ("http://alias.one/a", "http://bad.net/x"), ("https://alias.two/b", "http://alias.one/a"), ("http://mixed.one/a", "http://bad.net/y"), ("http://mixed.one/a", "http://good.net/y"),
        ("http://far.one/z", "http://far.two/1"), ("http://far.two/1", "http://far.two/2"), ("http://far.two/2", "http://bad.net/z"), (None, "http://bad.net/x"),
    ]
    got = judge(spark, urls, links)
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/", "org/", "allow")
    assert got[3] == ("x.com", "/de/9", "com/de/", "block")
    assert got[4] == ("x.com", "", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert [got[i][3] for i in (8, 9, 14, 11)] == ["block"] * 4  # aliases of a blocked page, also over several steps
    assert got[10][3] == "allow"  # an explicit allow goes first
    assert got[12] == ("notorg", "/", None, "allow")
    assert got[13] == ("u", "/://h/", None, "allow")


def test_no_pages_no_rules(spark):
    assert judge(spark, [], []) == {}
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, decision string")
    links = spark.createDataFrame([], "source string, target string")
    assert url_filters.judge_urls(pages, none, links).first().verdict == "allow"


def test_links_stated_by_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.org/x", '<LINK href="/y" rel=canonical>'), (2, "http://a.org/2", "<meta http-equiv='refresh' content='0; url=http://b.org/2'>"), (3, "http://a.org/3", None), (4, None, '<link rel="canonical" href="http://c.org/">'), (5, "http://a.org/5", '<link rel="canonical" href="y">')],
        "page_id long, url string, html string",
    )
    got = {(r.source, r.target) for r in url_filters.page_links(pages, relative=False).collect()}
    assert got == {("http://a.org/x", "http://a.org/y"), ("http://a.org/2", "http://b.org/2")}


def test_every_form_of_target_is_resolved(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', """<meta http-equiv="refresh" content="0; url='{}'">"""
    forms = [
        (canonical, "index2.html", ["http://a.org/d/index2.html"]), (canonical, "../a", ["http://a.org/a"]), (canonical, "?p=2", ["http://a.org/d/x?p=2"]),
        (refresh, "http://b.org/x", ["http://b.org/x"]), (refresh, "y", ["http://a.org/d/y"]), (canonical, "/go?to=https://x.org/", ["http://a.org/go?to=https://x.org/"]),
        (canonical, "//c.org/z", ["http://c.org/z"]), (canonical, "go?to=https://x.org/", ["http://a.org/d/go?to=https://x.org/"]), (canonical, "mailto:a@b?u=http://x.org/", []),
        (canonical, "http://d.org/é", ["http://d.org/%C3%A9", "http://d.org/é"]), (canonical, "HTTP://D.org/1/../2", ["HTTP://D.org/1/../2", "http://d.org/2"]),
    ]
    for tag, target, want in forms:
        page = spark.createDataFrame([("http://a.org/d/x?q=http://e.org/", tag.format(target))], "url string, html string")
        assert sorted(r.target for r in url_filters.page_links(page).collect()) == want, target
    # A decision reaches the page that a relative link names.
    pages = spark.createDataFrame([(1, "http://a.org/d/x", canonical.format("../bad")), (2, "http://a.org/bad", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("a.org", "/bad", "block")], "host string, path string, decision string")
    assert {r.verdict for r in url_filters.judge_urls(pages, rules, url_filters.page_links(pages)).collect()} == {"block"}


def test_search_is_exact(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = [centres[rng.randrange(6)] ^ (1 << rng.randrange(64)) * rng.randrange(2) ^ (rng.getrandbits(64) if i % 4 == 0 else 0) for i in range(700)] + [centres[0]] * 40
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, (None, 5), (9999, None), rows[3]], "id long, code long")
    for blocks in ({}, {"query_block": 40, "index_block": 150, "chunk": 7}):
        found = {}
        for r in hamming_search.top_k(df, df.where("id % 20 = 0"), k=5, **blocks).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
        assert set(found) == {i for i, _ in rows if i % 20 == 0}
        for q, answer in found.items():
            best = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:5]
            assert sorted(answer) == [(n + 1, d, i) for n, (d, i) in enumerate(best)]


def test_few_rows_and_none(spark):
    two = spark.createDataFrame([(0, 1), (20, 3)], "id long, code long")
    assert sorted(map(tuple, hamming_search.top_k(two, two, k=5).collect())) == [(0, 1, 20, 1), (20, 1, 0, 1)]
    none = spark.createDataFrame([], "id long, code long")
    assert hamming_search.top_k(none, two).count() == 0 and hamming_search.top_k(two, none).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, float("nan"), None, 2.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(hamming_search.sign_code(df.v)).collect()] == [0b100001, None, 0]


def test_rules_of_very_many_lengths(spark):
    """4,200 lengths of paths on one host: the longest rule decides, however many there are."""
    paths = ["/" + "a" * n for n in range(1, 4_201)]
    rules = spark.createDataFrame([("b.org", p, "block" if len(p) % 2 else "allow") for p in paths], "host string, path string, decision string")
    pages = spark.createDataFrame([(i, f"http://www.b.org{p}x", "") for i, p in enumerate(paths[::600] + paths[-1:])], "page_id long, url string, html string")
    got = {r.page_id: r.rule for r in url_filters.judge_urls(pages, rules, url_filters.page_links(pages)).collect()}
    assert got == {i: "b.org" + p for i, p in enumerate(paths[::600] + paths[-1:])}
