import random

import pytest
from pyspark.sql import functions as F

from tallycast.llm import url_cascade as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, ""), (len(h + p), h.count(".") + 1, h + p, v == "block"))
    return host, path, best and best[2], "allow" if not best or not best[3] else "block"


URLS = [None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q=/de/", "http://net", "http://net/", "http://x.net?a=/", "http://example.com/de/1#f",
        "http://badexample.com/de/1", "http://a.org/fr/x", "http://a.org/frx", "http://example.net/en", "ftp://u:p@Ö.example.com:80/de/", "a://b://c.net/", "x://.net/", "x://net./"]


def got(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in frame.collect()), key=str)


@pytest.mark.parametrize("bits", [None, 0])
def test_contract_rules(spark, bits):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], "h")] * 2, "page_id long, url string, host string")
    want = [(i, *brute(u, U.RULES)) for i, u in enumerate(URLS)] + [(None, *brute(URLS[4], U.RULES))] * 2
    assert got(U.url_verdicts(pages, U.default_rules(spark), max_bits=bits)) == sorted(want, key=str)
    assert got(U.url_verdicts(pages, U.default_rules(spark).limit(0))) == sorted([(i, *brute(u, [])) for i, u in enumerate(URLS)] + [(None, *brute(URLS[4], []))] * 2, key=str)
    assert got(U.url_verdicts(pages.limit(0), U.default_rules(spark), max_bits=bits)) == []


def test_many_rules_and_levels(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abc") for _ in range(draw.randint(1, n)))
    host = lambda: ".".join(word(2) for _ in range(draw.randint(1, 3)))
    rules = {(host(), draw.choice(["", "/", "/" + word(2), "/" + word(1) + "/"])): draw.choice(["allow", "block"]) for _ in range(300)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host()}.{host()}/{word(2)}/{word(2)}" for _ in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(((i, *brute(u, rules)) for i, u in enumerate(urls)), key=str)
    frame = U.url_verdicts(pages, spark.createDataFrame(rules, U.RULE_SCHEMA))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Join", "Exchange", "Python", "MapInArrow"))
    assert got(frame) == want
    assert got(U.url_verdicts(pages, spark.createDataFrame(rules, U.RULE_SCHEMA), max_bits=0)) == want


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.xxhash64("key") % 7 == 0)
    levels = U.build_cascade(listed, universe.unionAll(universe))
    assert len(levels) >= 4
    wrong = universe.filter(U.is_listed(F.col("key"), levels) != (F.xxhash64("key") % 7 == 0))
    assert wrong.count() == 0
    assert sum(level.bits for level in levels) < 8 * listed.count()
    assert U.build_cascade(listed.limit(0), universe) == [] and U.build_cascade(listed, universe, 1000) is None


def test_conflicts_odd_rules_and_long_hosts(spark):
    rules = [("b.c", "/", "allow"), ("B.C", "/", "block"), ("c", "x", "block"), ("a/b", "/", "block"), (None, "/z", None)]
    long = "x." * 100_000 + "b.c"
    pages = spark.createDataFrame([(1, "h://b.c/"), (2, f"h://{long}/" + "p" * 200_000), (3, "h://c/x"), (4, "h:///z")], "page_id int, url string")
    rows = U.url_verdicts(pages, spark.createDataFrame(rules, U.RULE_SCHEMA)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [("b.c/", "block"), ("b.c/", "block"), (None, "allow"), ("/z", "block")]
