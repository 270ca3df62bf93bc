import duckdb
import pandas as pd

from tallyframe.llm import urls

URLS = [
    "http://a.com/en/1", "http://example.com/en/7", "https://X.Example.COM/en/79?q", "http://com/en/", "http://acom/en/", "http://b.net/de/8", "http://example.net/de/8#x", "http://sub.example.net/de/", "http://z.org/es/4", "http://org/es", "http://a.com", "http://a.com/en", "no scheme a.com/en/", None, "", "://", "ftp://u.com?x=/en/", "http://a.com/EN/", "x://y://a.com/en/", "http://a.com./en/", "http://example.com:80/en/7", "http://\u00c9.com/en/\u00e9", "http://.com/en/x", "http://a.com/en/1",
]


def plain(url, rules=urls.RULES):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, key=lambda x: x[:2]) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def frame(spark, values):
    return spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(values)], "page_id long, url string, host string, key string")


def test_rules_equal_a_plain_version_and_sql(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(frame(spark, URLS)).collect()}
    assert [got[i] for i in range(len(URLS))] == [plain(u) for u in URLS]
    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})  # noqa: F841
    sql = {r[0]: r[1:] for r in duckdb.sql(f"select page_id, host, path, rule, verdict from ({urls.oracle()})").fetchall()}
    assert sql == got


def test_many_rules_need_deeper_cascades(spark):
    rules = tuple(("block" if i % 3 else "allow", f"h{i}.com/{i % 7}") for i in range(150))
    values = [f"http://{'s.' * (i % 3)}h{i}.com/{i % 11}{i}" for i in range(600)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(frame(spark, values), rules).collect()}
    assert [got[i] for i in range(len(values))] == [plain(u, rules) for u in values]


def test_a_cascade_is_exact_over_its_universe(spark):
    inside, outside = [f"in{i}" for i in range(60)], [f"out{i}" for i in range(800)]
    keys = urls.listed(spark, outside)
    levels = urls.cascades(keys, {"x": inside}, 20)["x"]  # a far too small universe makes many false positives
    assert len(levels) > 1
    from pyspark.sql import functions as F

    both = urls.listed(spark, inside + outside).select("key", urls.member(levels, F.col("key")).alias("m")).collect()
    assert {r.key for r in both if r.m} == set(inside)


def test_lists_of_any_length(spark, monkeypatch):
    rules = tuple(("block" if i % 3 else "allow", f"h{i}.com/{i % 7}") for i in range(12_000))
    values = [f"http://{'s.' * (i % 3)}h{i * 31}.com/{i % 11}{i}" for i in range(400)] + ["http://" + "a." * 300 + "h3.com/3" + "x" * 5000]
    want = [plain(u, rules) for u in values]
    for n_bytes in (urls.LITERAL_BYTES, 64):  # cascades, and the join beyond what a plan holds
        monkeypatch.setattr(urls, "LITERAL_BYTES", n_bytes)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(frame(spark, values), rules).collect()}
        assert [got[i] for i in range(len(values))] == want
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(frame(spark, URLS)).collect()}
    assert [got[i] for i in range(len(URLS))] == [plain(u) for u in URLS]


def test_empty_table_and_no_rules(spark):
    assert urls.filter_urls(frame(spark, [])).count() == 0
    assert [r.verdict for r in urls.filter_urls(frame(spark, ["http://a.com/en/"]), ()).collect()] == ["allow"]
