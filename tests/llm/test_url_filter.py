"""URL filters against a plain model: parts, rules, n-grams, fit and verdicts."""

import math
import re
import zlib

import pytest
from helpers import rows

from rillflow.llm import url_filter as U

URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM", "http://example.com/en/", "http://example.com/en", "https://x.example.com/en/1?a#b", "https://www.example.com/en/1", "https://sub.www.example.com/en/1",
        "http://wwwexample.com/en/1", "http://net/es/1", "http://a.net/es/", "http://a.net/ES/", "http://a.net/fr/x", "http://notnet/fr/x", "http://b.net/de", "a://b://c/d", "x\ny://h\nost/pa\nth#f", "http://é.org/ünï/日本", "http://a.org?q=/x", "http://casino-win.org/en/5",
        "http://" + "long." * 20_000 + "com/" + "p/" * 50_000, "http://" + "é" * 30_000 + ".org/" + "日" * 30_000]


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if m is None else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])


def features(host, path):
    out = []
    for tag, t in (("h", f".{host}." if host else ""), ("p", re.sub("[0-9]+", "0", path.lower()))):
        met = {zlib.crc32((tag + t[i : i + n]).encode()) % U.BUCKETS + 1 for n in U.SIZES for i in range(len(t) - n + 1)}
        out += [(b, 1 / math.sqrt(len(met))) for b in sorted(met)]
    return out


def fitted(labelled):
    found = [(features(*parts(u)), y) for u, y in labelled]
    b = p = 0.0
    w = dict.fromkeys((k for f, _ in found for k, _ in f), 0.0)
    q = dict(w)
    for _ in range(U.STEPS):
        r = [y - 1 / (1 + math.exp(-(b + sum(w[k] * c for k, c in f)))) for f, y in found]
        step = dict.fromkeys(w, 0.0)
        for (f, _), e in zip(found, r):
            for k, c in f:
                step[k] += e * c
        b, p = b + U.MOMENTUM * (b - p) + U.RATE / len(r) * sum(r), b
        w, q = {k: v * U.DECAY + U.MOMENTUM * (v - q[k]) + U.RATE / len(r) * step[k] for k, v in w.items()}, w
    return b, w


@pytest.fixture(scope="module")
def model(spark):
    return U.fit(U.labelled_urls(spark))


def test_fit_equals_plain_steps(model):
    b, w = fitted([(u, 1) for u in U.addresses(U.BLOCKED)] + [(u, 0) for u in U.addresses(U.ALLOWED)])
    assert abs(model.bias - b * U.MILLIONTHS) <= 2
    assert {k + 1 for k, v in enumerate(model.weights) if v} <= set(w)
    assert all(abs(model.weights[k - 1] - v * U.MILLIONTHS) <= 2 for k, v in w.items())


def verdict(url, model):
    host, path = parts(url)
    fits = [(len(t), -k, t, a) for k, (a, t) in enumerate(U.RULES) if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if model.bias + sum(model.weights[b - 1] * c for b, c in features(host, path)) > 0 else "allow"


def test_odd_urls(spark, model):
    table = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[8]), (8, URLS[8])]
    pages = spark.createDataFrame([(*r, "h", "p", "r", "f", 1) for r in table], "page_id long, url string, host string, path string, rule string, found string, features int")
    assert rows(U.judged(pages, model)) == sorted(((i, *verdict(u, model)) for i, u in table), key=str)
    assert U.judged(pages.limit(0), model).count() == 0


def test_held_out_addresses(spark):
    """Fitted on half of the labelled table, the model tells most of the other half apart."""
    table = [(k, u, 1) for k, u in enumerate(U.addresses(U.BLOCKED))] + [(k, u, 0) for k, u in enumerate(U.addresses(U.ALLOWED))]
    half = spark.createDataFrame([r for r in table if r[0] % 2], "k int, url string, label int")
    rest = [r for r in table if not r[0] % 2]
    got = U.judged(spark.createDataFrame([(n, r[1]) for n, r in enumerate(rest)], "page_id long, url string"), U.fit(half), rules=()).collect()
    right = [(r["verdict"] == "block") == bool(rest[r["page_id"]][2]) for r in got]
    blocked = [r["verdict"] == "block" for r in got if rest[r["page_id"]][2]]
    assert sum(right) >= 0.75 * len(right) and sum(blocked) >= 0.45 * len(blocked)  # measured: 0.80 and 0.51


def test_labels_with_holes(spark):
    none = U.fit(spark.createDataFrame([(None, 1), ("http://a.org/", None)], "url string, label int"))
    assert none == U.Model(0, (0,) * U.BUCKETS)
    both = U.fit(spark.createDataFrame([("http://a.org/", 1), ("http://a.org/", 0)], "url string, label int"), steps=5)
    assert both.bias == 0
    many = spark.createDataFrame([(f"http://spam{k}.org/", 1) for k in range(30)] + [(f"http://fine{k}.org/", 0) for k in range(30)], "url string, label int")
    assert U.fit(many, max_rows=10, steps=5) == U.fit(many, max_rows=10, steps=5)


def test_no_python_in_the_plan(spark, model):
    plan = U.judged(spark.createDataFrame([(1, "http://a.org")], "page_id long, url string"), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
