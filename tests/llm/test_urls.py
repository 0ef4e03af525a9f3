from lattice.llm import urls


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    return {r.page_id: r for r in urls.judge(spark, df, **kw).collect()}


def test_rules(spark):
    want = {
        "HTTP://A.Example.COM/de/1?x#y": ("a.example.com", "/de/1", "example.com/de/", "block"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://example.com/de": ("example.com", "/de", None, "allow"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "https://b.example.net/en/3": ("b.example.net", "/en/3", "example.net/en/", "allow"),
        "https://b.example.net/fr/3": ("b.example.net", "/fr/3", "net/", "block"),
        "https://other.org/fr/3": ("other.org", "/fr/3", "org/fr/", "allow"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net#f/a": ("x.net", "", None, "allow"),
        "no scheme/net/": ("", "", None, "allow"),
        "ftp://a.net/b://c": ("a.net", "/b://c", "net/", "block"),
    }
    out = judged(spark, [(i, u, "clash") for i, u in enumerate(want)])
    for i, w in enumerate(want.values()):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == w


def test_many_rules_agree_with_few(spark, monkeypatch):
    rows = [(i, u, None) for i, u in enumerate(["http://a.b.net/en/1", "http://example.net/en/1", "http://x.example.com/de/2", "http://q.org/fr/", "http://q.org/", None])]
    few = judged(spark, rows)
    monkeypatch.setattr(urls, "MAX_INLINE_RULES", 0)
    assert judged(spark, rows) == few


BLOCKED = (("block", "shop.com", "/a/1"), ("block", "shop.com", "/a/2"), ("block", "shop.com", "/a/3"))


def test_templates_alone_change_verdicts_of_rows_without_a_rule(spark):
    """/a/{v} is blocked by rules for 1.., 2.., 3..: the ids that no rule names follow their template, other branches do not."""
    rows = [(i, f"http://shop.com/a/{i}", None) for i in range(100, 400)] + [(i, f"http://shop.com/a/{i}", None) for i in range(400, 420)]
    rows += [(i, f"http://shop.com/b/{i}", None) for i in range(500, 900)] + [(i, f"http://other.com/a/{i}", None) for i in range(900, 950)]
    out = judged(spark, rows, rules=BLOCKED)
    unruled = {i: r for i, r in out.items() if r.rule is None}
    assert {r.verdict for i, r in unruled.items() if 400 <= i < 420} == {"block"} and {r.template for i, r in unruled.items() if 400 <= i < 420} == {"shop.com/a/{v}"}
    assert {r.verdict for i, r in unruled.items() if i >= 500} == {"allow"}
    none = judged(spark, rows, rules=())
    assert {r.verdict for r in none.values()} == {"allow"}


def test_templates_reach_any_depth_and_labels_replace_rules(spark):
    rows = [(i, f"http://h.com/x/y/z/{'good' if i % 2 else 'bad'}/{i}/p", None) for i in range(40)]
    marks = spark.createDataFrame([(i, True) for i in range(0, 30, 2)] + [(None, True)], "page_id long, bad boolean")
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = {r.page_id: r for r in urls.judge(spark, df, rules=(), labels=marks).collect()}
    assert {r.verdict for i, r in out.items() if i % 2 == 0} == {"block"} and {r.verdict for i, r in out.items() if i % 2} == {"allow"}
    assert {r.template for i, r in out.items() if i % 2 == 0} == {"h.com/x/y/z/bad/{v}/p"}


def test_wide_branches_become_wildcards_and_alike_ones_merge(spark):
    wide = [(i, f"http://w.com/{'abcdefghij'[i % 10]}{'klmnop'[i // 100]}x/{i}", None) for i in range(300)]
    marks = spark.createDataFrame([(i, True) for i in range(300) if i % 5] + [(1000 + i, True) for i in range(90)], "page_id long, bad boolean")
    alike = [(1000 + i, f"http://m.com/{'ab'[i % 2]}/{i}", None) for i in range(100)] + [(1100 + i, f"http://m.com/c/{i}", None) for i in range(100)]
    out = {r.page_id: r for r in urls.judge(spark, spark.createDataFrame(wide + alike, "page_id long, url string, host string"), rules=(), labels=marks).collect()}
    assert {r.template.split("/")[1] for i, r in out.items() if i < 300} == {"*"}
    assert {r.verdict for i, r in out.items() if i < 300} == {"block"}  # most rows of the wildcard
    assert {r.template.split("/")[1] for i, r in out.items() if 1000 <= i < 1100} == {"{a|..}"} and {r.verdict for i, r in out.items() if i >= 1100} == {"allow"}


def test_edges(spark):
    out = judged(spark, [(1, None, None), (2, "", None), (3, "http://a.com/" + "x/" * 20_000, None)])
    assert [(out[i].host, out[i].path) for i in (1, 2)] == [("", ""), ("", "")] and len(out[3].path) == 40_001
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert urls.judge(spark, df).count() == 2 and urls.judge(spark, df.limit(0)).count() == 0
