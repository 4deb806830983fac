"""Reversed search, URL rules and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cauldron.llm import reversed_search, urlfilter, vectorcode
from cauldron.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
TERM = re.compile(reversed_search.TERM_PATTERN)
LOWER = {c: c + 32 for c in range(65, 91)}


# ---- reversed search -------------------------------------------------------

def plain_search(docs, items, k):
    texts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    total, length = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        found = []
        for doc, c, n in texts:
            m = 25 + (75 * n * total) // length
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score:
                found.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **kw):
    got = reversed_search.search(spark.createDataFrame(docs, "doc_id long, text string"),
                                 spark.createDataFrame(items, "item_id long, text string"), **kw)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_search_equals_plain_scores(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_search(docs, items, 10)
    assert searched(spark, docs, items, k=10) == want
    # several blocks, each with its own pass, and an item above the bound
    assert searched(spark, docs, items[:6] + [(99, " ".join(t for _, t in items))], k=10, block_bytes=2_000) == \
        plain_search(docs, items[:6] + [(99, " ".join(t for _, t in items))], 10)


def test_search_on_odd_rows(spark):
    docs = [(1, "Die Straße ÄB äb"), (2, None), (3, ""), (None, "straße äb"), (4, "- !"), (5, "straße"), (5, "straße"),
            (6, "STRASSE x" * 3), (7, "word " * 50), (8, "a" * 10_000), (9, "b\x00c\x7fd b")]
    items = [(1, "straße ÄB b"), (1, "word word x"), (1, "word word x"), (2, None), (3, "!?"), (None, "straße"), (4, "a" * 10_000)]
    for k in (1, 2, 10):
        assert searched(spark, docs, items, k=k) == plain_search(docs, items, k)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []
    assert searched(spark, [(1, None)], [(1, None)]) == []


def test_search_ties_keep_the_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(i, f"filler{i} text") for i in range(600, 700)]
    want = [(7, r, r) for r in range(1, 11)]
    got = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    out = reversed_search.search(got, spark.createDataFrame([(7, "same words")], "item_id long, text string"))
    assert [(r.item_id, r["rank"], r.doc_id) for r in out.orderBy("rank").collect()] == want


def test_search_ignores_other_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 3, 4)], "doc_id long, text string, item_id string, n int, terms int")
    items = spark.createDataFrame([(1, "two", 5)], "item_id long, text string, doc_id int")
    assert reversed_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert reversed_search.search(docs, items).count() == 1


def test_long_texts_are_split_between_terms(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "c", "défi", "Z9"]) for _ in range(5_000)).encode()
    whole = reversed_search.term_counts(text)
    monkeypatch.setattr(reversed_search, "STEP_BYTES", 37)
    assert reversed_search.term_counts(text) == whole and whole[0] == 5_000


def test_document_factor_beyond_64_bits():
    n = np.array([1, 10 ** 9, 10 ** 12], np.int64)
    got = reversed_search.document_factor(n, 10 ** 10, 10 ** 14)
    assert got.tolist() == [25 + 75 * int(x) * 10 ** 10 // 10 ** 14 for x in n]


# ---- URL rules -------------------------------------------------------------

def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_judge(urls, rules, default="allow"):
    out = []
    for page, url in urls:
        host, path = plain_parts(url)
        fits = [(len(h + (p or "")), h.count("."), a == "block", h + (p or ""), a) for h, p, a in rules
                if h is not None and a is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, 0, 0, None, default))
        out.append((page, host, path, best[3], best[4]))
    return sorted(out, key=str)


def judged(spark, urls, rules, **kw):
    got = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"),
                          spark.createDataFrame(rules, "host string, path string, action string"), **kw)
    return sorted((tuple(r) for r in got.collect()), key=str)


URLS = [(1, "http://Example.ORG/en/12?q=/es/"), (2, "https://a.b.example.org/es/x#top"), (3, "https://notexample.org/es/"),
        (4, "http://x.com/fr/1"), (5, "http://com/de/"), (6, "http://x.com/de"), (7, None), (8, ""), (9, "no scheme/org/"),
        (10, "ftp://org"), (11, "http://org/"), (12, "http://example.org:80/es/"), (13, "http://a..org/x"), (14, "http://.org/"),
        (15, "http://x.org./en/"), (16, "x://y://z.org/"), (None, "http://q.org/a"), (17, "http://q.org/a"), (17, "http://q.org/a"),
        (18, "http://ÄÖ.org/ü/é"), (19, "http://" + "s." * 3_000 + "com/fr/" + "p" * 20_000), (20, "http:///en/1"),
        (21, "http://example.org\n/en/1"), (22, "http://example.org/en/1\n2")]


def test_contract_rules_on_odd_urls(spark):
    want = plain_judge(URLS, URL_RULES)
    assert judged(spark, URLS, URL_RULES) == want
    assert judged(spark, URLS, URL_RULES, shared_rules=0) == want  # both sides dealt by prefix and salt
    assert judged(spark, URLS, URL_RULES, shapes=1) == want  # every prefix is an expression


def test_rules_that_repeat_or_clash(spark):
    rules = [("org", "/", "allow"), ("org", "/", "block"), ("org", "/", "block"), (None, "/", "block"), ("com", None, "block"),
             ("com", "/fr/", None), ("a.b.example.org", "/", "allow"), ("example.org", "/es/x", "block"), ("", "/en/", "block"),
             ("q.org", "/", "allow"), ("org", "/a", "block"), ("äö.org", "/ü", "block")]
    urls = URLS + [(30, "http://äö.org/ü/é")]
    assert judged(spark, urls, rules) == plain_judge(urls, rules)


def test_random_urls_and_rules(spark):
    rng = random.Random(5)
    label, step = lambda: rng.choice("abc"), lambda: rng.choice(["/", "x", "xy"])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "".join(step() for _ in range(rng.randint(0, n)))
    rules = [(host(3), path(3), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, a) for h, p, a in rules}.values())
    urls = [(i, f"http://{host(5)}{path(6)}") for i in range(400)]
    assert judged(spark, urls, rules) == plain_judge(urls, rules)
    assert judged(spark, urls, rules, shared_rules=3, shapes=2) == plain_judge(urls, rules)


def test_no_rules_no_pages_other_columns(spark):
    assert judged(spark, URLS, []) == plain_judge(URLS, [])
    assert judged(spark, [], URL_RULES) == []
    pages = spark.createDataFrame([(1, "http://x.org/", "a", 5, "b")], "page_id long, url string, host string, weight int, rule string")
    rules = spark.createDataFrame([("org", "/", "block", 1, "x")], "host string, path string, action string, page_id int, digest string")
    assert [tuple(r) for r in urlfilter.judge(pages, rules).collect()] == [(1, "x.org", "/", "org/", "block")]


# ---- vector codes ----------------------------------------------------------

def plain_codes(rows, rounds=6):
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 8) * 8
    data = np.array([[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in rows], object).reshape(len(rows), width)
    d = width // 8
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:16]
    books = [[list(data[i, p * d:(p + 1) * d]) for i in order] for p in range(8)]

    def near(p, v):
        away = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
        return min(range(len(away)), key=lambda e: (away[e], e)), min(away)

    for _ in range(rounds):
        for p in range(8):
            took = [[] for _ in books[p]]
            for v in data[:, p * d:(p + 1) * d]:
                took[near(p, v)[0]].append(v)
            books[p] = [[sum(c) // len(t) for c in zip(*t)] if t else e for t, e in zip(took, books[p])]
    out, by_label = [], Counter()
    for (i, _, lab), v in zip(rows, data):
        found = [near(p, v[p * d:(p + 1) * d]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(a for _, a in found), lab))
        by_label[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], sha) for i, c, e, lab in out), key=str)


def coded(spark, rows, partitions=3, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(partitions)
    return sorted((tuple(r) for r in vectorcode.encode(df, **kw).collect()), key=str)


def vectors(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, width))
    return [(i, (middle[i % 5] + 0.2 * rng.normal(size=width)).round(3).tolist(), int(i % 3)) for i in range(n)]


def test_codes_equal_plain_rounds(spark):
    rows = vectors(300)
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, shared_labels=1) == plain_codes(rows)  # the salted join of labels


def test_codes_of_odd_rows(spark):
    nan = float("nan")
    rows = vectors(60, 8) + [(None, [0.5] * 8, None), (61, None, 1), (62, [0.1, None] * 4, 1), (63, [nan] * 8, 1),
                             (64, [float("inf")] * 8, 2), (65, [1.0, 2.0, 3.0], None), (66, [], 0), (0, [0.25] * 8, 0)] \
        + [(70 + i, [0.125] * 8, 9) for i in range(80)]
    assert coded(spark, rows) == plain_codes(rows)
    few = vectors(5, 8)
    assert coded(spark, few) == plain_codes(few)
    assert coded(spark, [(1, None, 1)]) == [] and coded(spark, []) == []
    assert coded(spark, [(1, [], 1), (2, [], None)]) == plain_codes([(1, [], 1), (2, [], None)])
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [1e300] * 8, 1)])


def test_codes_ignore_other_columns(spark):
    df = spark.createDataFrame([(i, v, lab, "x", 1.0) for i, v, lab in vectors(20, 8)],
                               "vec_id long, embedding array<double>, label int, code string, error double")
    assert vectorcode.encode(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_shortlists_settle_blocks_and_lose_no_entry():
    rng = np.random.default_rng(2)
    middle = rng.integers(-20_000, 20_000, size=(16, 8))
    points = middle[rng.integers(0, 16, 4_000)] + rng.integers(-400, 400, size=(4_000, 8))
    ordered, places, boxes, sums = vectorcode.lay_out(points)
    assert (ordered == points[places]).all() and sums.sum(0).tolist() == points.sum(0).tolist()
    found, away, settled = vectorcode.nearest(ordered, boxes, middle, measured=True)
    every = ((ordered[:, None, :] - middle[None]) ** 2).sum(-1)
    assert (found == every.argmin(1)).all() and (away == every.min(1)).all()
    assert settled.mean() > 0.5  # the curve keeps neighbours together, so boxes decide most blocks


def test_hilbert_neighbours_touch():
    """Every two cells in a row along the curve differ by one in one axis."""
    side = np.arange(16)
    for d in (2, 3):
        grid = np.stack(np.meshgrid(*[side] * d, indexing="ij"), -1).reshape(-1, d)
        keys = vectorcode.hilbert_keys(np.repeat(grid, 1, 0))
        walk = grid[np.argsort(keys)]
        assert len(set(keys.tolist())) == len(grid)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).mean() > 0.9
