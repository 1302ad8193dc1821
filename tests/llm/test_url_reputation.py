from pyspark.sql import functions as F

from escalade.llm import url_reputation as u

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def judge(spark, urls, outcomes):
    pages = spark.createDataFrame(urls, "page_id bigint, url string, host string, n int")
    out = spark.createDataFrame(outcomes, "host string, bad int")
    return u.judge_urls(pages, out, RULES)


def test_parts_rules_and_odd_urls(spark):
    urls = [(1, "HTTP://Blog.Example.NET/en/x?q=1", "clash", 1), (2, "http://a.net", "c", 1), (3, "http://a.net/", "c", 1),
            (4, "https://EXAMPLE.com/de/1#x", "c", 1), (5, "http://badexample.com/de/1", "c", 1), (6, None, "c", 1),
            (7, "no scheme", "c", 1), (8, "", None, None), (9, "x://h?u=y://z/net/", "c", 1), (10, "http://a.org/fr/1", "c", 1),
            (10, "http://a.org/fr/1", "c", 1), (11, "http://example.net/enx", "c", 1)]
    rows = judge(spark, urls, []).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls)
    assert got == {
        1: ("blog.example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.net", "", None, "allow"),
        3: ("a.net", "/", "net/", "block"), 4: ("example.com", "/de/1", "example.com/de/", "block"),
        5: ("badexample.com", "/de/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("h", "", None, "allow"), 10: ("a.org", "/fr/1", "org/fr/", "allow"),
        11: ("example.net", "/enx", "net/", "block")}


def test_posterior_against_plain_python(spark):
    hosts = {"a.x.com": (40, 36), "b.x.com": (3, 3), "c.x.com": (30, 2), "d.y.com": (20, 1), "e.y.com": (0, 0), "f.z.co.uk": (50, 45),
             "g.z.co.uk": (12, 11), "1.2.3.4": (2, 2)}
    urls = [(i, f"http://{h}/p", "", 0) for i, h in enumerate(hosts)]
    outcomes = [(h, int(j < k)) for h, (n, k) in hosts.items() for j in range(n)]
    rows = {r.host: r for r in judge(spark, urls, outcomes).collect()}
    domain = {"a.x.com": "x.com", "b.x.com": "x.com", "c.x.com": "x.com", "d.y.com": "y.com", "e.y.com": "y.com",
              "f.z.co.uk": "z.co.uk", "g.z.co.uk": "z.co.uk", "1.2.3.4": "1.2.3.4"}
    suffix = {"x.com": "com", "y.com": "com", "z.co.uk": "co.uk", "1.2.3.4": "1.2.3.4"}

    def total(children, parent):
        out = {}
        for c, (n, k) in children.items():
            p = parent(c)
            out[p] = (out.get(p, (0, 0))[0] + n, out.get(p, (0, 0))[1] + k)
        return out

    def strength(children, parent):
        top = base = 0.0
        for p in {parent(c) for c, (n, _) in children.items() if n}:
            own = [v for c, v in children.items() if parent(c) == p and v[0]]
            n, k, m = sum(v[0] for v in own), sum(v[1] for v in own), len(own)
            rate = k / n
            v = rate * (1 - rate)
            top += sum(x[1] ** 2 / x[0] for x in own) - k * rate - v * (m - 1)
            base += v * (n - sum(x[0] ** 2 for x in own) / n - (m - 1))
        rho = min(max(top / base if base > 0 else u.RHO_MIN, u.RHO_MIN), u.RHO_MAX)
        return 1 / rho - 1

    d = total(hosts, domain.get)
    s = total(d, suffix.get)
    all_n, all_k = sum(v[0] for v in s.values()), sum(v[1] for v in s.values())
    ms, md, mh = strength(s, lambda x: 0), strength(d, suffix.get), strength(hosts, domain.get)
    for h, (n, k) in hosts.items():
        # priors from all hosts but this one
        (sn, sk), (dn, dk) = s[suffix[domain[h]]], d[domain[h]]
        whole = (all_k - k) / (all_n - n) if all_n > n else 0.1
        ps = (ms * whole + sk - k) / (ms + sn - n)
        pd = (md * ps + dk - k) / (md + dn - n)
        a, b = mh * pd + k, mh * (1 - pd) + n - k
        assert abs(rows[h].bad_rate - a / (a + b)) < 1e-9
        assert (rows[h].verdict == "block") == (rows[h].bad_bound > 0.5)
    assert rows["a.x.com"].verdict == "block" and rows["c.x.com"].verdict == "allow"


def test_empty_tables(spark):
    assert judge(spark, [], []).count() == 0
    assert judge(spark, [], [("a.com", 1)]).count() == 0


def test_hot_host_is_salted(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("http://hot.example.org/x").alias("url"))
    out = u.judge_urls(pages, spark.createDataFrame([("hot.example.org", 1)] * 30, "host string, bad int"), RULES)
    assert out.groupBy("verdict").count().collect()[0]["count"] == 5000


def test_one_bad_label_blocks_no_host(spark):
    """The host's own outcome isn't also in the rates of its domain and suffix."""
    urls = [(1, "http://new.org/x", "", 0), (2, "http://good.com/x", "", 0)]
    rows = {r.host: r for r in judge(spark, urls, [("new.org", 1)] + [("good.com", int(i % 10 == 0)) for i in range(50)]).collect()}
    assert rows["new.org"].verdict == "allow" and rows["new.org"].bad_bound < 0.3
    alone = judge(spark, urls[:1], [("new.org", 1)]).first()
    assert alone.verdict == "allow"
