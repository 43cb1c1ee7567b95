"""The url filter, the filter audit and hard negatives against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from llm_rows import CLASHING, frame, odd_rows, words
from pyspark.sql import functions as F

from goalweave.llm import common, op11_urls, op12_filters, op13_negatives
from goalweave.llm.queries import RULES


def clashing(df):
    for i, name in enumerate([*CLASHING, "verdict", "chance", "mask", "part", "digest", "slot", "number", "score", "rank"]):
        df = df if name in df.columns else df.withColumn(name, F.lit(str(i)))
    return df


# ---- urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return lowered, tail[:stop]


def plain_rule(host, path, rules):
    fitting = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fitting, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)


def plain_features(host, path):
    row = np.zeros(op11_urls.BUCKETS + 1)
    for mark, text in (("h", host), ("p", re.sub("[0-9]+", "0", path))):
        ended = f"^{text}$"
        grams = [ended[i : i + n] for n in op11_urls.GRAMS for i in range(len(ended) - n + 1)]
        for g in grams:
            hashed = xxhash.xxh64_intdigest((mark + g).encode(), seed=42)
            row[hashed % op11_urls.BUCKETS if hashed < 2**63 else (hashed - 2**64) % op11_urls.BUCKETS] += 1 / math.sqrt(len(grams))
    row[-1] = 1.0
    return row


def plain_model(rows):
    """Accelerated gradient descent, to the end."""
    x = np.array([plain_features(*plain_parts(u)) for u, _ in rows])
    y = np.array([b for _, b in rows], dtype=float)
    ridge = np.full(x.shape[1], op11_urls.RIDGE)
    ridge[-1] = 0
    used = np.flatnonzero(np.abs(x).sum(axis=0))
    x, ridge = x[:, used], ridge[used]
    w = z = np.zeros(len(used))
    t = 1.0
    for _ in range(6000):
        gradient = x.T @ (1 / (1 + np.exp(-x @ z)) - y) / len(y) + ridge * z
        if np.linalg.norm(gradient) < 1e-6:
            break
        following, faster = z - gradient / 0.76, (1 + math.sqrt(1 + 4 * t * t)) / 2
        if gradient @ (following - w) > 0:
            faster = 1.0
        z, w, t = following + (t - 1) / faster * (following - w), following, faster
    full = np.zeros(op11_urls.BUCKETS + 1)
    full[used] = z
    return full


URLS = [
    None,
    "",
    "no scheme at all",
    "http://",
    "://x",
    "https://A.Example.COM/en/1",
    "https://www.example.com/en/",
    "https://www.example.com/en",
    "http://x.www.example.com/en/9?q=/es/",
    "https://example.com",
    "https://example.com?x=1",
    "https://com/",
    "https://net/es/1",
    "https://net/ES/1",
    "https://a.net/es/#top",
    "https://notexample.com/en/1",
    "https://user@a.net:80/fr/1",
    "https://a.net/fr/1#/x?y",
    "http://É.example.org/ä/\n://b.net/es/",
    "http://b.net/es/http://c.com/",
    "http://" + "long" * 5000 + ".org/" + "ab/" * 20_000,
]


@pytest.fixture(scope="module")
def url_model(spark):
    table = op11_urls.labelled_urls(spark)
    return [tuple(r) for r in table.select("url", "blocked").collect()]


def test_urls_equal_plain_version(spark, url_model, sf_dir):
    rows = list(enumerate(URLS)) + [(3, "http://again.org/"), (3, "http://again.org/"), (None, "https://cheap-pills.example.net/en/1")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string").repartition(3))
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = op11_urls.judged(pages.select("page_id", "url").unionByName(given.select("page_id", "url")), RULES).collect()
    weights = plain_model(url_model)
    expected = [(r.page_id, r.url) for r in given.select("page_id", "url").collect()] + rows
    assert len(found) == len(expected)
    wanted = sorted(((i if i is not None else -1, *plain_parts(u)) for i, u in expected))
    assert sorted((r.page_id if r.page_id is not None else -1, r.host, r.path) for r in found) == wanted
    for r in found:
        rule = plain_rule(r.host, r.path, RULES)
        assert r.rule == (rule and rule[1] + rule[2])
        if not r.host and not r.path:
            assert r.chance is None and r.verdict == "allow"
            continue
        chance = 1 / (1 + math.exp(-max(-30.0, min(30.0, plain_features(r.host, r.path) @ weights))))
        assert abs(r.chance - chance) < 0.02
        assert r.verdict == (rule[0] if rule else "block" if r.chance >= 0.5 else "allow")
    assert op11_urls.judged(pages, RULES).columns == ["page_id", "host", "path", "rule", "verdict", "chance"]


def test_url_model_on_sites_it_never_saw(spark):
    """Sites of the test pages: none of them is in the labelled table."""
    unwanted = "spam-farm cheap-pills casino-win free-bets ads-track adult-x".split()
    ordinary = "ththre tionble thering ththth thernd tiontion ththsh ththea tionsh ththin".split()
    known = {r.url for r in op11_urls.labelled_urls(spark).collect()}
    rows = [(w, f"https://blog.{w}.example.{end}/en/{i}") for i, w in enumerate(unwanted + ordinary) for end in ("com", "net", "org")]
    assert not known & {u for _, u in rows} and not set(unwanted + ordinary) & set(op11_urls.UNWANTED + op11_urls.ORDINARY)
    found = op11_urls.judged(spark.createDataFrame(rows, "page_id string, url string"), []).collect()
    assert all(r.verdict == ("block" if r.page_id in unwanted else "allow") for r in found)


def test_urls_without_model_or_rows(spark):
    one_kind = spark.createDataFrame([("http://a.com/", 1), (None, 0), ("http://b.com", None)], "url string, blocked int")
    pages = spark.createDataFrame([(1, "https://casino.org/"), (2, "https://net/es/")], "page_id long, url string")
    assert [tuple(r) for r in op11_urls.judged(pages, RULES, one_kind).orderBy("page_id").collect()] == [
        (1, "casino.org", "/", None, "allow", None),
        (2, "net", "/es/", "net/es/", "block", None),
    ]
    assert op11_urls.judged(pages.limit(0), RULES).count() == 0
    kept = op11_urls.kept_pages(clashing(pages), RULES, one_kind)
    assert [r.page_id for r in kept.collect()] == [1] and kept.columns == clashing(pages).columns
    with pytest.raises(ValueError):
        op11_urls.judged(pages, [("allow", f"h{i}.com", "/") for i in range(501)], one_kind)


# ---- filters


def plain_audit(rows, labels):
    """Every order applied to every document, one filter after the other."""
    texts = [(i, t or "", s or "") for i, t, s in rows]
    known = {}
    for i, q, x in labels:
        a, b = known.get(i, (0, 0))
        known[i] = (max(a, int(q == 1)), max(b, int(x == 1)))
    docs = []
    for i, t, part in texts:
        w = t.encode().split()
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(set(t) & set("#$%&*|")),
            "E": i is not None and any(o is not None and o < i and u == t for o, u, _ in texts),
        }
        docs.append((part, {f for f in "ABCDE" if fails[f]}, known.get(i, (0, 0)) if i is not None else (0, 0)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                removed_by[f] += len(gone)
                failing = [d for d in mine if f in d[1]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2][0] for d in gone), sum(d[2][1] for d in gone),
                ]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_audit_equals_plain_version(spark):
    draw = random.Random(5)
    texts = [words(i, draw.choice([5, 150, 250]), draw.choice([20, 4000])) for i in range(25)]
    texts += [t.upper() for t in texts[:5]] + [t + " 100%" for t in texts[5:12]]
    rows = [(100 + i, draw.choice(texts), draw.choice(["a", "b", "b", "", None])) for i in range(120)]
    rows += [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in odd_rows()]
    labels = [(r[0], draw.choice([0, 1, None]), draw.choice([0, 1])) for r in rows if draw.random() < 0.6]
    labels += [(None, 1, 1), (100, 1, 0), (100, 0, 1), (10**6, 1, 1)]
    table = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3))
    found = op12_filters.audit(frame(spark, rows), table).collect()
    wanted = plain_audit(rows, labels)
    assert len(found) == len(wanted)
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in found} == wanted


def test_audit_of_nothing(spark):
    docs, labels = frame(spark, [(1, None, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op12_filters.audit(docs.limit(0), labels).count() == 0
    found = op12_filters.audit(docs, labels).collect()
    assert len(found) == 600 and {r.part for r in found} == {""}
    # An empty text fails A alone: 0 distinct words of 0, 0 capitals of 0.
    assert {(r.filter_order[r.step - 1], r.removed, r.unique_fails, r.shapley) for r in found} == {("A", 1, 1, 120), *((f, 0, 0, 0) for f in "BCDE")}


def test_walk_follows_gray_code():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 50, (7, 32, 3))
    states = op12_filters.walked(counts)
    for subset in range(32):
        kept = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == counts[:, kept].sum(axis=1)).all()


# ---- hard negatives


def plain_negatives(rows):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    rows = [r for r in rows if all(x is not None and math.isfinite(x) for x in r[1])]
    moved = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v, k in rows]
    out = []
    for a, k, v in moved:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in moved]
        same = sorted((s, i) for s, i, l in scored if l == k and i != a)[:5]
        others = sorted((s, i) for s, i, l in scored if l != k)
        for p, positive in same:
            inside = [(s, i) for s, i in others if 50 * -p <= 100 * -s <= 95 * -p][:3]
            clip = lambda s: max(-(2**63), min(2**63 - 1, -s))
            out += [(a, positive, n, i, clip(p), clip(s)) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def found_negatives(df):
    return sorted(tuple(r) for r in op13_negatives.hard_negatives(df).collect())


def test_negatives_equal_plain_version(spark, monkeypatch):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(4, 6))
    rows = [(i, (centers[i % 4] + draw.normal(size=6) / 2).astype(np.float32).tolist(), [0, 0, 0, 3, 9][i % 5]) for i in range(700)]
    # Ties, repeats, zeros, gaps, unequal lengths, rows that take no part.
    rows += [(i, rows[i - 700][1], rows[i - 700][2]) for i in range(700, 760)] + [rows[51], rows[51], rows[100]]
    rows += [(2000, [0.0] * 6, 3), (2050, [], 3), (2051, [1.0, 2.0], 3), (2100, [float("nan")] * 6, 0), (2101, [float("inf"), 1, 1, 1, 1, 1], 0)]
    rows += [(2150, None, 0), (2151, [None, 1.0], 0), (None, [1.0] * 6, 0), (2200, [1.0] * 6, None), (-50, [0.5] * 6, 3), (2250, [0.1] * 9, 8)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, k) for i, v, k in rows]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(4))
    wanted = plain_negatives(rows)
    assert len(wanted) > 100
    assert found_negatives(df) == wanted
    monkeypatch.setattr(op13_negatives, "ROWS", 37)
    monkeypatch.setattr(op13_negatives, "ANCHORS", 3)
    assert found_negatives(df) == wanted


def test_negatives_of_nothing(spark):
    assert found_negatives(spark.createDataFrame([], VECTORS)) == []
    assert found_negatives(spark.createDataFrame([(50, [1.0], 1)], VECTORS)) == []
    assert found_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VECTORS)) == []


@pytest.mark.parametrize("size", [1.0, 300.0, 2.0**20, 2.0**33, 2.0**45, 1e30])
def test_packed_products_are_exact(size):
    """Fields of 4, 8 and more bytes; scores beyond a long end at its bounds."""
    draw = np.random.default_rng(7)
    vectors = [draw.normal(size=n) * size for n in (5, 5, 3, 0, 5)]
    numbers = op13_negatives.whole_numbers(np.concatenate(vectors), np.array([len(v) for v in vectors]))
    plain = [[math.floor(256 * x) for x in v] + [0] * (5 - len(v)) for v in vectors]
    assert numbers.tolist() == plain
    anchors = numbers[[0, 2, 4]]
    packed = op13_negatives.PackedRows(numbers, anchors)
    for i, a in enumerate((0, 2, 4)):
        exact = [sum(x * y for x, y in zip(plain[a], row)) for row in plain]
        assert packed.scores(i).tolist() == [max(-(2**63), min(2**63 - 1, s)) for s in exact]


def test_best_takes_ties_by_id():
    score, ids = np.array([5, 7, 7, 5, 9, 7, -(2**63)]), np.array([4, 9, 3, 1, 8, 2, 0])
    assert op13_negatives.best(score, ids, np.arange(7), 3).tolist() == [4, 5, 2]
    assert op13_negatives.best(score, ids, np.array([6, 0]), 3).tolist() == [0, 6]
    assert op13_negatives.best(score, ids, np.array([], dtype=int), 3).tolist() == []


def test_no_python_in_the_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    df = op11_urls.judged(pages, RULES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "html" not in plan
    assert common.partitions(spark) == 8
