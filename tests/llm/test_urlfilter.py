import random

from pyspark.sql import functions as F

from commitloom.llm import queries, urlfilter

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[at:]
    end = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:at]), path[:end]


def brute(rows, listed):
    out = []
    for page, url in rows:
        host, path = parts(url)
        fits = [(len(h + p), -i, h + p, a) for i, (a, h, p) in enumerate(RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], best[3] if best else "block" if host in listed else "allow"))
    return sorted(out, key=str)


def run(spark, rows, listed):
    pages = spark.createDataFrame([(*r, "<p>", "h") for r in rows], "page_id long, url string, html string, host string")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    return sorted(map(tuple, urlfilter.filter_urls(pages, queries.URL_RULES, keys).collect()), key=str)


def urls(n=400):
    r = random.Random(8)
    hosts = [f"{a}{i}.{b}" for i in range(30) for a in ("x", "ads", "www.É") for b in ("com", "example.com", "net", "EXAMPLE.net", "org", "dev")]
    out = [f"{r.choice(['http', 'https', 'ftp'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/7', '/en/1', '/de/8x', '/de/', '/es/', '/EN/'])}{r.choice(['', '?a=/en/', '#x', '?://y'])}" for _ in range(n)]
    return out + [None, "", "no scheme", "://", "http://", "http:///path", "http://com/en/", "http://xcom/en/", "a://b\nc/en/", "http://long.com/" + "p" * 100_000, "x?://net/de/1"]


def test_verdicts_equal_brute_force(spark):
    rows = list(enumerate(urls())) + [(3, "http://ads1.com"), (None, "http://ads1.com"), (3, "http://ads1.com")]
    listed = sorted({parts(u)[0] for u in urls() if "ads" in parts(u)[0]})
    assert run(spark, rows, [*listed, None, "nowhere.com", listed[0]]) == brute(rows, set(listed))
    assert run(spark, rows, [""]) == brute(rows, {""})
    assert run(spark, rows, []) == brute(rows, set())
    assert run(spark, [], listed) == []


def test_a_cascade_beyond_its_bound_is_dealt_into_parts(spark, monkeypatch):
    rows = list(enumerate(urls()))
    listed = {parts(u)[0] for u in urls() if "ads" in parts(u)[0]}
    monkeypatch.setattr(urlfilter, "MOST_BYTES", 32)
    assert urlfilter.parts_of(len(listed), 4 * len(listed)) >= 3
    assert run(spark, rows, sorted(listed)) == brute(rows, listed)


def test_levels_correct_each_other(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 3)
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.col("key").endswith("7"))
    levels = urlfilter.build_cascade(listed, universe)
    assert len(levels) > 2
    wrong = universe.where(urlfilter.listed_by(levels, F.col("key")) != F.col("key").endswith("7"))
    assert wrong.count() == 0
