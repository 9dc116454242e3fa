import random

from pyspark.sql import functions as F

from tagsieve.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), len(rule_host), rule, verdict))
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def judged(spark, found, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(found)], "page_id long, url string, rule string")
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, "url", listed).collect()}


def test_against_plain_matching(spark):
    rng = random.Random(3)
    hosts = ["example.org", "a.Example.org", "org", "xorg", "b.com", "com", "a.b.c.d.org", "example.org:80", "", "com."]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/", "//", "/ES/"]
    ends = ["", "?q=/fr/", "#x", "?://a.com/de/"]
    found = [f"{rng.choice(['http', '', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(ends)}" for _ in range(300)]
    found += [None, "", "no scheme", "http:/x", "a://b://c.com/de/", "x" * 50_000, "http://" + "a." * 3000 + "com/fr/"]
    assert judged(spark, found, RULES) == {i: plain(u, RULES) for i, u in enumerate(found)}


def test_many_listed_urls(spark):
    rng = random.Random(4)
    rules = [(f"h{rng.randrange(60)}.t{rng.randrange(3)}/{rng.choice(['', 'a', 'a/b', 'c/'])}{i % 7}", "block") for i in range(400)]
    rules = list(dict(rules).items())
    found = [f"http://x.h{rng.randrange(80)}.t{rng.randrange(4)}/{rng.choice(['', 'a', 'a/b', 'c/', 'd'])}{rng.randrange(9)}z" for _ in range(600)]
    assert judged(spark, found, rules) == {i: plain(u, rules) for i, u in enumerate(found)}


def test_a_list_of_two_thousand_lengths(spark):
    """A URL meets the lengths of its own hosts only."""
    rules = [(f"long{i % 5}.org/{'x' * i}", "block") for i in range(2000)] + [("com/a", "block"), ("net/", "allow")]
    found = [f"http://a.long{i % 6}.org/{'x' * (i * 37 % 2100)}" for i in range(60)]
    found += [f"http://h{i}.com/{'a' * (i % 3)}{i}" for i in range(100)] + ["http://other.net/" + "y" * 3000]
    assert judged(spark, found, rules) == {i: plain(u, rules) for i, u in enumerate(found)}
    cut = spark.createDataFrame([(f"h{i}.com", "/" + "a" * 2500) for i in range(100)], "host string, path string")
    listed = spark.createDataFrame(rules, "rule string, verdict string")
    hosts = urls.rules_of(listed).groupBy(F.col("host").alias("listed")).agg(F.collect_set(F.length("path")).alias("lengths"))
    assert urls._candidates(cut, hosts, [1, 2], 4).count() == 100


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).selectExpr("concat('k', id) as entry")
    other = spark.range(20_000).selectExpr("concat('o', id) as entry")
    blocks = 2000 * urls.BITS_PER_ENTRY // urls.BLOCK_BITS
    blooms = urls.bloom_filter(listed, "entry", blocks)
    assert urls.possible(listed, "entry", blooms, blocks).count() == 2000
    assert urls.possible(other, "entry", blooms, blocks).count() < 400


def test_odd_tables(spark):
    assert judged(spark, ["http://a.org/", "http://a.org/"], []) == {i: ("a.org", "/", None, "allow") for i in (0, 1)}
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([(None, "block"), ("org/", None), ("/x", "block"), ("org/", "allow"), ("ORG/", "block")], "rule string, verdict string")
    assert [r.verdict for r in urls.judge(pages, "url", rules).collect()] == ["block"]
    assert urls.judge(pages.limit(0), "url", rules).count() == 0
