from tallyspark.llm.urlrules import judge_urls

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PAGES = [
    (1, "http://a.net/x", '<link rel=canonical href="https://Safe.com/page?q=1&amp;r=2#z">', "a.net", "/x", "net/", "block"),
    (2, "https://safe.com/page?q=1&r=2", None, "safe.com", "/page", None, "block"),
    (3, "http://c.com/old", '<meta http-equiv="Refresh" content="0; url=/new">', "c.com", "/old", None, "block"),
    (4, "http://c.com/new", '<LINK HREF="//b.net/" rel="canonical nofollow">', "c.com", "/new", None, "block"),
    (5, "http://q.com/a/b", '<link rel="canonical" href="c">', "q.com", "/a/b", None, "allow"),
    (6, "http://q.com/a/c", "<link rel=canonical href=\"http://x.org/fr/1\">", "q.com", "/a/c", None, "allow"),
    (7, "http://z.net/d", '<link rel=canonical href="http://q.com/a/c">', "z.net", "/d", "net/", "block"),
    (8, None, "x", "", "", None, "allow"),
    (9, "nothing", "", "", "", None, "allow"),
    (10, "HTTP://EXAMPLE.net/EN/x", "", "example.net", "/EN/x", "net/", "block"),
    (11, "http://foo.example.NET/en/x?y", "", "foo.example.net", "/en/x", "example.net/en/", "allow"),
    (12, "http://net", "", "net", "", None, "allow"),
    (13, "http://internet/", "", "internet", "/", None, "allow"),
    (14, "x://a?b://c/d", "", "a", "", None, "allow"),
    (None, "http://sub.org/fr/?z", '<meta http-equiv="refresh" content="5; url=http://b.net/">', "sub.org", "/fr/", "org/fr/", "allow"),
    (16, "http://only.self/", '<link rel="canonical" href="http://only.self/">', "only.self", "/", None, "allow"),
    (17, "http://m.com/" + "p" * 5000, "<p>" * 2000, "m.com", "/" + "p" * 5000, None, "allow"),
]


def test_verdicts(spark):
    rows = [(i, u, h, "clash", 1) for i, u, h, *_ in PAGES + PAGES[:2]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict int")
    got = [(r["id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, RULES).collect()]
    assert sorted(got, key=str) == sorted([(i, u, *x) for i, u, _, *x in PAGES + PAGES[:2]], key=str)


def test_many_rules_as_a_table_against_plain_python(spark):
    import random

    rng = random.Random(8)
    labels = ["a", "b", "net", "org", "x", ""]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    starts = ["", "/"] + ["/" + "".join(rng.choice("pq/") for _ in range(rng.randrange(0, 5))) for _ in range(60)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts).upper(), rng.choice(starts)) for _ in range(6000)]  # more than a plan should hold
    urls = [f"http://{rng.choice(hosts)}{rng.choice(starts)}{rng.choice(['', '?q', '#f', 'z/y'])}" for _ in range(300)] + [None, "", "none", "http://"]

    def naive(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("#")[0].split("?")[0]
        fits = [(len(at) + len(s), v == "allow", at + s) for v, at, s in ((v, at.lower(), s) for v, at, s in rules) if (host == at or host.endswith("." + at)) and path.startswith(s)]
        best = max(fits, default=(0, True, None))
        return host, path, best[2], "allow" if best[1] else "block"

    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    table = spark.createDataFrame(rules + [(None, "net", "/"), ("block", None, "/"), ("block", "net", None)], "verdict string, host string, start string")
    want = {k: naive(u) for k, u in enumerate(urls)}
    for limit in (1 << 30, 0):  # broadcast, and not
        got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, table, broadcast_bytes=limit).collect()}
        assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
        assert all(len(got[k][2] or "") == len(want[k][2] or "") for k in want)
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}


def test_redirect_table_chains_and_empty(spark):
    df = spark.createDataFrame([(k, f"http://h{k}.com/", None) for k in range(30)], "page_id long, url string, html string")
    hops = spark.createDataFrame([(f"http://h{k}.com", f"http://h{k + 1}.com/") for k in range(20)] + [("http://h20.com/", "http://b.net/")], "src string, dst string")
    got = {r["id"]: r["verdict"] for r in judge_urls(df, RULES, redirects=hops).collect()}
    assert got == {k: "block" if k <= 20 else "allow" for k in range(30)}
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "<link rel=canonical href=/x>")], "page_id long, url string, html string")
    plan = judge_urls(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_the_sql_says_the_same():
    import duckdb
    import pandas as pd

    from tallyspark.llm.queries import URL_RULES, oracle_sql

    assert set(URL_RULES) == set(RULES)
    pages = pd.DataFrame([(i, u, h) for i, u, h, *_ in PAGES], columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("frame", pages)
    con.sql("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM frame")
    got = con.sql(oracle_sql()["op7_url_filters"]).select("page_id, host, path, rule, verdict").fetchall()
    assert sorted(got, key=str) == sorted([(i, *x) for i, _, _, *x in PAGES], key=str)
