from boundwell.llm import url_filter as U
from boundwell.llm.queries import RULES, rules


def judge(urls, table, default="allow"):
    """Longest rule that fits, by trying all."""
    out = []
    for u in urls:
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
        fits = [r for r in table if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        out.append((host, path, best and best[0] + best[1], best[2] if best else default))
    return out


URLS = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net/en", "http://a.example.com/de/1", "http://xexample.com/de/1", "https://x.org/fr/?q", "http://x.org/FR/", "ftp://a://b.net/q",
    "http://É.net/é", "http://a..net/", "http://.net/", "http://net./", "http://a.net?x/en/", "http://u:p@b.net:80/", "x://\n/a\nb", "http://a.net/\U0010ffff\U0010ffff", "http://example.net/en/" + "q" * 30_000,
]


def check(spark, urls, table):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = U.judge_urls(pages, rules(spark, table)).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == judge(urls, table)


def test_contract(spark):
    check(spark, URLS, RULES)


def test_nested_rules(spark):
    table = [("net", "", "block"), ("net", "/a", "allow"), ("net", "/a/b/", "block"), ("x.net", "/", "allow"), ("y.x.net", "", "block"), ("b.net", "/a/b/c", "allow"), ("o'k.net", "/'", "block")]
    hosts = ["net", "x.net", "y.x.net", "z.y.x.net", "b.net", "c.b.net", "yx.net", "o'k.net"]
    check(spark, [f"http://{h}{p}" for h in hosts for p in ("", "/", "/a", "/a/", "/a/b", "/a/b/", "/a/b/c", "/a/b/c/d", "/ab", "/'x", "/\U0010ffff")], table)


def test_equal_rules_null_rules_and_empty_tables(spark):
    table = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("", "", "block"), ("b.com", None, "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (2, "http://b.com"), (None, "http://c.com")], "page_id long, url string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in U.judge_urls(pages, table).collect())
    assert got == [("1", "a.com/", "block"), ("1", "a.com/", "block"), ("2", "b.com", "block"), ("None", None, "allow")]
    assert U.judge_urls(pages.limit(0), table).count() == 0
    assert [r.verdict for r in U.judge_urls(pages, table.limit(0), default="block").collect()] == ["block"] * 4


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = U.judge_urls(pages, rules(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_common_hosts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(U, "PART_ROWS", 3)
    urls = [f"http://{h}/{'en/' * (i % 2)}{i}" for i in range(25) for h in ("example.net", "a.example.net", "b.org", "c.com")]
    check(spark, [*urls, *URLS], RULES)


def test_a_host_of_thousands_of_labels(spark):
    check(spark, ["http://" + "a." * 2000 + "example.net/en/x", "http://" + "." * 1500 + "org/fr/"], RULES)
