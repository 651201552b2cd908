from pyspark.sql import functions as F

from wardline.llm import url_filter as U


def by_hand(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), -h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits) if fits else None
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://com", "https://Example.COM/en/1?x#y", "https://www.example.com/en/",
    "https://a.www.example.com/en/q", "http://m.example.com/EN/", "http://a.net/es/1", "http://a.net/es", "http://net/fr/://x", "x://y://z.com/",
    "http://É.com/en/", "http://example.com/en/\nb", "http://exampleXcom/en/", "http://.com/", "http://" + "a." * 5000 + "net/fr/" + "b" * 200_000,
    "http://a.net/es/1",
]


def test_rules_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r[1:] for r in U.judge(pages, U.rule_table(spark, U.RULES)).select("page_id", "host", "path", "rule", "verdict").collect()}
    for i, url in enumerate(URLS):
        assert tuple(got[i]) == by_hand(url, U.RULES), url


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert U.judge(pages, U.rule_table(spark, [])).first()["verdict"] == "allow"
    assert U.judge(pages.limit(0), U.rule_table(spark, U.RULES)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.xxhash64("key") % 40 == 0)
    found = U.cascade(listed, universe)
    assert len(found.levels) > 1
    wrong = universe.filter(found.contains(F.col("key")) != (F.xxhash64("key") % 40 == 0))
    assert wrong.count() == 0
    assert sum(level.bits for level in found.levels) < 20 * listed.count()


def test_main_path_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    plan = U.judge(pages, U.rule_table(spark, U.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
