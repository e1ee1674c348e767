"""URL rules against a plain loop: many path rules on one host, equal rules, long URLs, clashing names, several ranges."""

import random
import time

import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import urlfilter  # noqa: E402

RULES = "host string, path string, verdict string"


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.lower()
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("zones", [1, 7])
def test_nested_and_equal_rules(spark, zones):
    r = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "aa.com", "org", "x.org", "a-b.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/b", "/ab"]
    rules = [(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http://{r.choice(['', 'w.', 'z.w.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '/x', '?q', '#f'])}" for _ in range(500)]
    urls += [None, "", "http://a.com/" + "a/b/c/" * 20_000, "http://" + "a." * 3000 + "com/a"]
    pages = spark.createDataFrame([(i, u, "k", 1, True) for i, u in enumerate(urls)], "page_id long, url string, key string, zone int, is_url boolean").repartition(5)
    got = {x.page_id: tuple(x)[1:] for x in urlfilter.judged(pages, spark.createDataFrame(rules, RULES), zones=zones).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert urlfilter.judged(pages, spark.createDataFrame([], RULES)).where("rule is not null or verdict <> 'allow'").count() == 0


def test_many_path_rules_of_one_host():
    """A URL costs a few look-ups, not one test for each rule."""
    one = urlfilter._Host("com/", "com")
    for i in range(100_000):
        one.add(f"/{i:06d}/", "block")
    began = time.time()
    found = [one.longest(f"/{i:06d}/x") for i in range(20_000)]
    assert found == [f"/{i:06d}/" for i in range(20_000)] and time.time() - began < 2
    assert one.longest("/") is None
