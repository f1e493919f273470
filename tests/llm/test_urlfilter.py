import random

import duckdb
import pytest

from quirefold.llm import urlfilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAGES = "page_id bigint, url string, html string, host string, rule string, _key string"


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def judge(url, rules, default="allow"):
    host, path = parted(url)
    best = None
    for h, p, v in rules:
        if h is None or p is None or v is None:
            continue
        h = h.translate(LOWER)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), v, h + p))
    return host, path, best and best[3], best[2] if best else default


def frame(spark, urls):
    return spark.createDataFrame([(i, u, None, "clash", "clash", "clash") for i, u in urls], PAGES).repartition(3)


def check(spark, urls, rules, **more):
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urlfilter.filter_urls(frame(spark, urls), given, **more).select("row.page_id", "host", "path", "rule", "verdict").collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *judge(u, rules, **more)) for i, u in urls), key=key)


HOSTS = ["com", "example.com", "www.example.com", "a.www.example.com", "notexample.com", "example.net", "net", "x.org", "", "com.", "a..com", ".com", "example.com:80", "community"]
PATHS = ["", "/", "/en/", "/en", "/en/1", "/es/2", "/fr/", "/EN/3", "/en//x", "/é/\U0001f600", "//", "/com/"]


def urls():
    out = [(n, f"http://{h}{p}{t}") for n, (h, p, t) in enumerate((h, p, t) for h in HOSTS for p in PATHS for t in ("", "?q=://x/en/", "#/en/"))]
    out += [(None, "https://WWW.Example.COM/en/9"), (None, None), (1, None), (1, ""), (2, "no scheme/en/"), (3, "://com/"), (3, "://com/"), (4, "a://b://com/")]
    out += [(5, "http://" + "a." * 50_000 + "com/en/" + "x" * 100_000), (6, "http://com/" + "y/" * 100_000), (7, "ıhttp://com\n/\n")]
    return out


def test_contract_rules(spark):
    check(spark, urls(), list(urlfilter.RULES))


def test_many_nested_rules_over_slices(spark):
    r = random.Random(5)
    rules = [(".".join(h.split(".")[-k:]), p, v) for h in HOSTS for k in (1, 2, 3) for p in PATHS for v in ("allow", "block") if r.random() < 0.4]
    rules += [("com", "/" + "a" * k, "block") for k in range(40)] + [(None, "/", "block"), ("com", None, "block"), ("com", "/", None)]
    more = [(1000 + k, "http://x.com/" + "a" * (k % 60) + "b") for k in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        check(spark, urls() + more, rules, default="block")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_rules_and_no_pages(spark):
    check(spark, urls()[:20], [])
    check(spark, [], list(urlfilter.RULES))


def test_hot_key_is_split(spark):
    """Equal urls fall into several slices, and the rules they lie under are opened in each."""
    check(spark, [(n, "http://www.example.com/en/") for n in range(3000)] + urls(), list(urlfilter.RULES))


@pytest.mark.parametrize("empty", [False, True])
def test_sql(spark, tmp_path, empty):
    frame(spark, [] if empty else urls()).select("page_id", "url").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in urlfilter.op13_urlfilter(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(urlfilter.OP13_SQL).fetchall()))
