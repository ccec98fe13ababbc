"""Mined rules against a plain miner that tries every combination of tokens."""

import math
import random
import time
from itertools import combinations

import pytest

from granary.llm import url_rules


def tokens(url):
    rest = url.partition("://")[2]
    path, _, query = rest.partition("?")
    host, _, path = path.partition("/")
    digits = lambda x: "".join("0" if c.isdigit() and (i == 0 or not x[i - 1].isdigit()) else "" if c.isdigit() else c for i, c in enumerate(x))
    return {f"h={x}" for x in host.split(".") if x} | {f"p={digits(x)}" for x in path.split("/") if x} | {f"q={x.split('=')[0]}" for x in query.split("&") if x.split("=")[0]}


def plain_verdicts(labelled, asked, support, confidence, hits):
    rows = [(tokens(u), bad) for u, bad in labelled]
    least = max(hits, math.ceil(support * len(rows)))
    base, z, rules = sum(b for _, b in rows) / len(rows), url_rules.Z, []
    known = sorted(set().union(*(t for t, _ in rows)))
    for size in range(1, 5):
        for combo in combinations(known, size):
            met = [b for t, b in rows if t.issuperset(combo)]
            n, k = len(met), sum(met)
            if k < least or k / n < confidence:
                continue
            p = k / n
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if low > base:
                rules.append((set(combo), p))
    return {u: max((p for c, p in rules if c <= tokens(u)), default=None) for u in asked}


@pytest.mark.parametrize("seed", range(3))
def test_rules_equal_those_of_a_plain_miner(spark, seed):
    r = random.Random(seed)
    urls = [f"http://{r.choice('abc')}.{r.choice(['shop', 'news'])}/{r.choice(['buy', 'read'])}/{r.choice('xyz')}{r.randrange(30)}{r.choice(['', '?ref=1', '?id=2&ref=3'])}" for _ in range(300)]
    labelled = [(u, r.random() < (0.9 if "buy" in u and "shop" in u else 0.75 if "ref" in u and "/x" in u else 0.1)) for u in urls]
    asked = urls[:80] + ["http://a.shop/buy", "http://new.site/x1?ref=4"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(labelled, "url string, bad boolean"), min_support=0.02, min_confidence=0.5, min_hits=8)
    want = plain_verdicts(labelled, asked, 0.02, 0.5, 8)
    rows = got.collect()
    assert len(rows) == len(asked)
    for x in rows:
        p = want[asked[x["page_id"]]]
        assert x["verdict"] == ("block" if p is not None else "allow")
        # a rule that goes for a shorter one of equal or higher confidence never lowers the best
        assert (x["confidence"] is None) == (p is None) and (p is None or abs(x["confidence"] - p) < 1e-12)
    assert any(x["verdict"] == "block" for x in rows) and any(x["verdict"] == "allow" for x in rows)


def test_deep_paths_mine_in_seconds(spark):
    path = "/".join(f"segment-{chr(97 + i)}" for i in range(26)) + "/one/two/three/four"
    labelled = [(f"http://deep.org/{path}/{i}", True) for i in range(100)] + [(f"http://flat.org/{i}", False) for i in range(100)]
    bad = spark.createDataFrame(labelled, "url string, bad boolean")
    began = time.time()
    rules, known = url_rules.mine_rules(bad)
    assert rules.count() == 1 and known.count() >= 30 and time.time() - began < 30
    pages = spark.createDataFrame([(1, f"http://deep.org/{path}/7"), (2, "http://other.org/segment-c/"), (3, "http://flat.org/5")], "page_id long, url string")
    # each of the merged tokens stands for the item
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, bad).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_noise_gives_no_rules(spark):
    r = random.Random(9)
    labelled = [(f"http://{r.choice('abcdefgh')}.org/{r.choice('uvwxyz')}/{i}", r.random() < 0.26) for i in range(1000)]
    assert url_rules.mine_rules(spark.createDataFrame(labelled, "url string, bad boolean"))[0].isEmpty()
