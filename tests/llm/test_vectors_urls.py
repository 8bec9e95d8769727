"""Vector and url operators beside brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import embed_dedup, topk, url_rules

VECTORS = "vec_id long, embedding array<float>, label int, key string, v int, d int, n int, rep long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], VECTORS)


def odd_vectors(rng):
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for k in range(150):
        x = [c + rng.gauss(0, 0.08) for c in rng.choice(base)]
        rows.append((k, x, rng.choice([0, 0, 1, None])))
    copy = base[0]
    rows += [(200 + k, copy, 0) for k in range(30)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 8, 0), (303, [None, *[1.0] * 7], 0), (304, [math.nan] * 8, 1), (305, [math.inf, *[0.0] * 7], 1)]
    rows += [(None, copy, 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (5, copy, 0), (308, [-0.0, *copy[1:]], 0), (309, [0.0, *copy[1:]], 0)]
    return rows


def as_floats(x):
    return None if x is None else [None if c is None else float(np.float32(c)) for c in x]


def whole(x):
    return bool(x) and all(c is not None and math.isfinite(c) for c in x)


def test_embedding_groups(spark):
    rows = [(i, as_floats(x), l) for i, x, l in odd_vectors(random.Random(1))]
    ok = [i is not None and l is not None and whole(x) and any(x) for i, x, l in rows]

    def near(a, b):
        (_, x, la), (_, y, lb) = rows[a], rows[b]
        if not (ok[a] and ok[b] and la == lb and len(x) == len(y)):
            return False
        x, y = np.array(x), np.array(y)
        return (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98

    links = [[b for b in range(len(rows)) if b != a and near(a, b)] for a in range(len(rows))]
    want = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None) if ok[a] else i
        want.append((i if i is not None else -1, len(links[a]), low if low is not None else -1, i == low))
    got = embed_dedup.embedding_groups(table(spark, rows)).collect()
    got = [(-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in got]
    assert sorted(got) == sorted(want)
    assert max(w[1] for w in want) > 30


def test_bounds_give_up_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 24))
    y = x[rng.integers(0, 60, 90)] * rng.uniform(0.1, 9, (90, 1)) + rng.normal(size=(90, 24)) * 0.15
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    i, j = embed_dedup.linked_pairs(x, y, axes, 0.97)
    cosine = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(cosine >= 0.97)), strict=True))


def test_embedding_groups_of_nothing(spark):
    assert embed_dedup.embedding_groups(table(spark, [])).collect() == []
    assert [r["kept"] for r in embed_dedup.embedding_groups(table(spark, [(4, None, None)])).collect()] == [True]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    rows = [(i, None if x is None else [None if c is None or not math.isfinite(c) else math.floor(256 * c) for c in x]) for i, x, _ in odd_vectors(rng)]
    rows += [(1000, [5] * 8), (1001, [5] * 8), (1000, [5] * 8), (2000, [1, 2, 3])]
    docs = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in rows], "vec_id long, v array<long>, d int, rank int, block int")
    got = topk.top_k(docs, F.col("vec_id") % 10 == 0, k=5).collect()
    valid = [(i, x) for i, x in rows if i is not None and x and None not in x]
    want = set()
    for q, x in {(i, tuple(x)) for i, x in valid if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in valid if i != q and len(y) == len(x))
        want |= {(q, x, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    assert sorted((q, k, i, s) for q, _, k, i, s in want) == sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert topk.top_k(docs.filter("vec_id < 0"), F.lit(True)).collect() == []


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 6))
    tree = topk.build_tree(x, np.arange(500), leaf=20)
    for at, (s, e) in enumerate(tree["span"]):
        assert (tree["low"][at] == tree["x"][s:e].min(axis=0)).all() and (tree["high"][at] == tree["x"][s:e].max(axis=0)).all()
    assert sorted(tree["ids"].tolist()) == list(range(500))


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("a.example.org", "/es/x", "allow"), ("example.org", "/es/xy", "block"), ("", "/", "block"), (None, "/", "block"),
    ("UPPER.net", None, "block"), ("same.net", "/", "allow"), ("same.net", "/", "block"),
]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    best = None
    for rhost, rpath, verdict in RULES:
        rhost, rpath = (rhost or "").lower(), rpath or ""
        if rhost and (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            rank = (len(rhost) + len(rpath), len(rhost), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, rhost + rpath, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["org", "example.org", "a.example.org", "b.a.Example.ORG", "xexample.org", "com", "x.com", "com.org", "upper.net", "z.same.net", "hot.example.org", "", "org.", "é.org"]
    paths = ["", "/", "/es/", "/es/x", "/es/xyz", "/en/1", "/en/12?q=/es/", "/en/2", "/fr/", "/de/#x", "/fr", "?a=1", "#f"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += ["http://hot.example.org/es/x"] * 300 + [None, "", "no scheme", "://", "a://b://c/d"]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h", "r", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, range int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules).collect()
    key = lambda r: tuple("~" if x is None else str(x) for x in r)
    want = [(i if i % 50 else None, u, *judge(u)) for i, u in enumerate(urls)]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert url_rules.judge_urls(pages.filter("page_id < 0"), rules).collect() == []
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.filter("host = 'none'"), default="block").collect()} == {"block"}
