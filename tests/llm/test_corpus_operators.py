"""Operators over the whole corpus against plain versions: near-duplicates, repeats, mixing, top-k and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cauldron.llm import mixing, simhash, substring, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# ---- SimHash ---------------------------------------------------------------

def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, doc in enumerate(ids):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return [low[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    texts = docs.toPandas().sort_values("doc_id").text.tolist()
    fps = [plain_fingerprint(t) for t in texts]
    assert got.fingerprint.tolist() == [format(f, "016x") for f in fps]
    assert got.component_id.tolist() == plain_components(got.doc_id.tolist(), fps, 2)


def crowded(n, seed=1):
    """Clusters, chains, extremes and a dense ball."""
    rnd = random.Random(seed)
    out = {0, 2 ** 64 - 1, 1 << 63}
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(n // 8):
            out.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))))
    at = rnd.getrandbits(64)
    for _ in range(40):
        at ^= (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        out.add(at)
    return sorted(out | {rnd.getrandbits(64) for _ in range(n // 4)})


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("way", ["trees", "dense"])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, bits, way):
    fps = crowded(360)
    if way == "trees":
        monkeypatch.setattr(simhash, "SHARD_NODES", 40)
    else:
        monkeypatch.setattr(simhash, "SHARD_BOUND", 1)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.components(simhash.links(nodes, bits)).collect()
    root = {f: f for f in signed} | {r.node: r.root for r in found}
    ours, want = defaultdict(set), defaultdict(set)
    for f, u, c in zip(signed, fps, plain_components(range(len(fps)), fps, bits)):
        ours[root[f]].add(u)
        want[c].add(u)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_shard_links_on_one_dense_ball():
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(1500)})
    links = simhash.shard_links(np.array(fps, np.uint64), 2)
    assert len(links) == len(fps) - 1 - (len(set(plain_components(range(len(fps)), fps, 2))) - 1)


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_near_duplicates_edge_cases(spark):
    rows = [(3, None, "s"), (1, "", "s"), (5, "a b c d", "s"), (4, "A b  C\td", "s"), (5, "a b c d", "s"),
            (None, "a b c d", None), (None, "quite another text here", None), (9, "x " * 50_000, None), (7, "one", "s")]
    docs = frame(spark, rows).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by = defaultdict(set)
    for doc, fp, component in got:
        by[doc].add((fp, component))
    assert by[3] == by[1] == {("0" * 16, 1)}
    assert {c for _, c in by[5] | by[4]} == {4} and {c for _, c in by[None]} == {4, None}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [
        (-1, "quite another text here"), (1, ""), (4, "A b  C\td"), (7, "one"), (9, "x " * 50_000)]
    twice = simhash.drop_near_duplicates(frame(spark, [(5, "a b c", "s"), (5, "a b c", "s"), (5, "other words", "s")]))
    assert sorted(r.text for r in twice.collect()) == ["a b c", "other words"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


# ---- substring dedup -------------------------------------------------------

def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def test_repeats_are_cut_wherever_they_stand(spark):
    rnd = random.Random(7)
    passage, shared_line = prose(rnd, 80), prose(rnd, 6)
    rows = []
    for i in range(60):
        body = [prose(rnd, rnd.randrange(5, 60)) for _ in range(4)]
        if i % 3 == 0:  # in the middle of a line, other case and punctuation round it
            words = body[1].split()
            body[1] = " ".join(words[:3] + [passage.upper() if i % 2 else passage] + words[3:])
        rows.append((i, "\n".join([shared_line, *body]), "s"))
    clean = {i for i, _, _ in rows if i % 3}
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows)).collect()}
    text = {i: t for i, t, _ in rows}
    for i, r in got.items():
        left, at = [], 0
        for span in r.removed:
            left.append(text[i][at:span.start])
            at = span.end
        assert "".join(left) + text[i][at:] == r.text  # offsets are those of the original
        assert r.n_words == len(text[i].split())
        if i in clean or i == 0:
            assert r.n_removed == 0 and r.text == text[i]
        else:
            assert 55 <= r.n_removed <= 80
            assert set(text[i].split()) - set(passage.split()) - set(passage.upper().split()) <= set(r.text.split())


def test_units_do_not_depend_on_what_surrounds_a_line():
    import pyarrow as pa

    line = prose(random.Random(1), 40)
    one, two = substring.Units(pa.array([line])), substring.Units(pa.array(["x y\n" + line + "\nz", line]))
    whole = one.digests.tolist()
    assert two.digests.tolist()[two.rows[1]:] == whole and any(
        two.digests.tolist()[i:i + len(whole)] == whole for i in range(3))


def test_repeats_edge_cases(spark):
    line = prose(random.Random(2), 30)
    rows = [(None, line, "s"), (1, line, "s"), (2, None, "s"), (3, "", "s"), (4, " \n\n ", None), (5, "é " * 60_000, None),
            (6, f"{line}\n{line}", "s"), (7, "Ünï " + line, "s"), (7, "Ünï " + line, "s"), (8, "short line", "s"),
            (9, "short line", "s")]
    docs = frame(spark, rows).withColumn("removed", F.lit(1))
    got = sorted(((r.doc_id or -1, r.text, r.n_removed) for r in substring.remove_repeats(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for doc, text, n in got:
        by[doc].append((text, n))
    assert by[-1] == [(line, 0)] and by[1] == [("", 30)] and by[2] == [(None, 0)] and by[3] == [("", 0)]
    assert by[6] == [("", 60)] and by[5][0][1] == 0 and by[8] == by[9] == [("short line", 0)]
    assert len(by[7]) == 2 and by[7][0] == by[7][1] and by[7][0][0].startswith("Ünï")
    clean = substring.without_repeats(docs)
    assert clean.columns == docs.columns and clean.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert clean.where("n_chars <> length(text)").count() == 0
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_in_scripts_without_spaces(spark):
    rnd = random.Random(5)

    def han(n):
        return "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n))

    passage = han(560)
    rows = [(1, passage, "s"), (2, han(40) + passage + "。" + han(30), "s"), (3, "ก" * 3 + "ไทย" + passage[:200], "s"),
            (4, han(300), "s"), (5, "短い\nline one\n" + passage, "s"), (6, "短い\nline one", "s")]
    text = {i: t for i, t, _ in rows}
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got[1].n_removed == got[4].n_removed == got[6].n_removed == 0 and got[1].n_words == 560
    assert got[2].n_removed >= 545 and text[2][:40] in got[2].text and got[2].text.endswith(text[2][-30:])
    assert 180 <= got[3].n_removed <= 200 and got[3].text.startswith("กกกไทย")
    assert got[5].text == "短い\nline one\n" and got[5].n_removed == 560


def plain_repeats(rows, min_words):
    """(doc_id, words removed) by looking at every unit of every row in the order of (doc_id, unit, key)."""
    import pyarrow as pa

    found = []
    for i, t in rows:
        units = substring.Units(pa.array([t]))
        found += [((i, k), int(d), int(n)) for k, (d, n) in enumerate(zip(units.digests, units.size))]
    first = {}
    for place, digest, _ in found:
        first[digest] = min(first.get(digest, place), place)
    gone, run = Counter(), Counter()
    for (i, k), digest, n in sorted(found) + [((None, 0), None, 0)]:
        if digest is None or k == 0 or first[digest] == (i, k):
            for doc, total in run.items():
                gone[doc] += total if total >= min_words else 0
            run.clear()
        if digest is not None and first[digest] != (i, k):
            run[i] += n
    return gone


@pytest.mark.parametrize("min_words", [1, 20])
def test_repeats_equal_a_plain_search(spark, monkeypatch, min_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = plain_repeats(rows, min_words)
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs.repartition(3), min_words).collect()}
    assert got == {i: want[i] for i, _ in rows} and sum(got.values()) > 0


def test_repeats_do_not_depend_on_the_slices(spark):
    import pyarrow as pa

    rnd = random.Random(11)
    lines = [prose(rnd, 25) for _ in range(30)]
    texts = ["\n".join(rnd.choice(lines) for _ in range(3)) for _ in range(200)]
    units = substring.Units(pa.array(texts))
    doc = np.repeat(np.arange(200), np.diff(units.rows))
    seen, later = substring.Earliest(2), 0
    for i in rnd.sample(range(200), 200):  # one row at a time, hardly any places
        own = np.flatnonzero(doc == i)
        digest, at = np.unique(units.digests[own], return_index=True)
        zero = np.zeros(len(at), np.int64)
        before = seen.later(digest, zero + 1, zero + i, at, zero)
        later += before.sum()
        for d in digest[before]:
            assert doc[units.digests == d].min() < i
    assert later
    zero = np.zeros(1, np.int64)
    assert not substring.Earliest(2).later(np.zeros(1, np.uint64), zero + 1, zero + 5, zero, zero).any()


def test_rows_without_id_whose_hashes_share_32_bits(spark):
    stock, own = (" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    texts = [stock, f"a189041\n{stock}", f"b29796\n{own}"]  # the last two agree in the low half of their hash
    docs = frame(spark, [(None, t, "s") for t in texts])
    assert docs.selectExpr("count(DISTINCT xxhash64(text) & 4294967295)").first()[0] == 2
    got = {r.text: r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert got[texts[2]] == 0 and sum(got.values()) == 30


# ---- mixing ----------------------------------------------------------------

def plain_targets(sizes, share=1.5, weights=(3, 1, 2), repeats=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(repeats * sizes[s] for s in full)
        target = {s: repeats * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def check_mix(rows, texts):
    sizes = defaultdict(int)
    for source, text in texts:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        assert r.taken == sum(p.end - p.begin for p in r.pieces)
        for epoch in (0, 1):  # a pass draws no word twice
            spans = sorted((p.begin, p.end) for p in r.pieces if p.epoch == epoch)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(0 <= a < b <= r.size for a, b in spans)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * sizes[s]), s


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sources = docs.select("doc_id", "source")
    got = mixing.mix(docs).join(sources, "doc_id").collect()
    check_mix(got, [(r.source, r.text) for r in docs.collect()])
    again = mixing.mix(docs.repartition(5)).join(sources, "doc_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    shards = Counter(p.shard for r in got for p in r.pieces)
    assert len(shards) == 64 and max(shards.values()) < 2 * min(shards.values())


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", None), (2, None, None), (None, "d e", "s"), (4, "", "empty"), (5, "x " * 40_000, "big"),
            (6, "f g h i", "s"), (6, "f g h i", "s"), (7, "j", "t")]
    docs = frame(spark, rows).withColumn("size", F.lit(0)).withColumn("target", F.lit("x"))
    drawn = mixing.draw(docs.withColumn("_size", mixing.word_count(F.col("text"))).withColumn(
        "_order", F.xxhash64("doc_id", "text")).select("doc_id", "source", "_size", "_order"))
    assert drawn.count() == len(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got if r.size == 40_000) == pytest.approx(
        plain_targets({None: 3, "s": 10, "empty": 0, "big": 40_000, "t": 1})["big"], rel=0.01)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "s"), (2, "", None)])).where("taken = 0 AND target = 0").count() == 2


def test_mixture_keeps_the_words_drawn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    rows = mixing.mixture(docs).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixture(docs).columns == docs.columns


def test_parts_of_a_shard_follow_the_words(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(str, mixing.mixture(docs).collect()))
    monkeypatch.setattr(mixing, "PART_WORDS", 64)
    parts = mixing.mixture(docs)
    assert sorted(map(str, parts.collect())) == whole
    plan = parts._jdf.queryExecution().toString()
    assert "_part" in plan and "shiftright" in plan.lower()


def test_hypergeometric_moments(spark):
    drawn = spark.range(4000).select(mixing.hypergeometric(
        F.lit(500).cast("long"), F.lit(120).cast("long"), F.lit(250).cast("long"),
        (F.col("id") + 0.5) / 4000).alias("x")).toPandas().x
    assert drawn.mean() == pytest.approx(60, abs=0.05)
    assert drawn.var() == pytest.approx(120 * 250 * 380 * 250 / (500 ** 2 * 499), rel=0.02)
    edge = spark.createDataFrame([(0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5), (1, 1, 0)], "n long, k long, m long")
    assert [r.x for r in edge.select(mixing.hypergeometric(F.col("n"), F.col("k"), F.col("m"), F.lit(0.5)).alias("x")).collect()] == [
        0, 3, 0, 2, 0]


def test_split_quotas_are_exact(spark):
    quotas = [0, 1, 17, 1000, 33]
    rows = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), 4).collect()
    assert sorted(r.shard for r in rows) == list(range(16))
    assert np.sum([r.quotas for r in rows], 0).tolist() == quotas
    totals = [sum(r.quotas) for r in rows]
    assert max(totals) - min(totals) <= 1


# ---- exact top-k -----------------------------------------------------------

def plain_top(vectors, query_ids, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q in query_ids:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    rnd = np.random.default_rng(1)
    vectors = [(i, rnd.normal(size=6).round(1).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[i % 5][1]) for i in range(100)]  # copies: ties
    vectors += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [0.0] * 6),
                (405, []), (406, [1.0, 2.0]), (None, [1.0] * 6), (500, [2.0 ** 60] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<double>, rank int, score string")
    vectors, df = vectors[:-1], df.where("vec_id IS NULL OR vec_id < 500")
    want = plain_top(vectors, {i for i in range(0, 410, 7)} | {404, 405, 406})
    asked = df.where("vec_id % 7 = 0 OR vec_id IN (404, 405, 406)")
    for how in ({}, {"shard_rows": 40, "query_block": 7}):
        got = topk.top_k(df, asked, 10, **how)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = topk.top_k(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert [r.vec_id for r in few] == [r[2] for r in plain_top(vectors[:4], {0})]


def test_every_query_row_has_its_own_list(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=4).round(3).tolist()) for i in range(30)]
    rows += [(0, rows[0][1]), (0, rnd.normal(size=4).tolist()), (7, rows[7][1])]  # a copy, another vector of that id, a copy
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    data = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in rows]
    want = []
    for q, v in (data[j] for j in (0, 30, 31, 7, 32)):
        best = sorted((-int(v @ c), i) for i, c in data if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for how in ({}, {"shard_rows": 5, "query_block": 2}):
        got = topk.top_k(df, df.where("vec_id IN (0, 7)"), 4, **how).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_threshold_stops_early():
    rnd = np.random.default_rng(2)
    rows = np.floor(rnd.normal(size=(5000, 3)) * 1024)
    order, asked = np.argsort(rows, 0, kind="stable"), np.array([1024.0, 0.0, 0.0])
    met = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype == np.int64:
                met.append(len(at))
            return super().__getitem__(at)

    ids = np.arange(5000)
    found = topk.threshold_top(ids, rows.view(Counting), order, -1, asked, 10)
    assert sum(met) < 200
    assert found[0] == sorted(ids.tolist(), key=lambda i: (-rows[i] @ asked, i))[:10]


def test_large_integers_stay_exact():
    a = topk._matrix([[2.0 ** 60, 1.0], [3.0, 4.0]])
    assert a.tolist() == [[2 ** 70, 1024], [3072, 4096]]


# ---- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    at, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, at, SF)
        if name != "packing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        at = seen[name] = spark.read.parquet(path)
    words = mixing.word_count(F.col("text"))
    assert seen["language_id"].count() >= 0.98 * docs.count()
    deduped = simhash.near_duplicates(seen["language_id"])
    assert seen["near_dedup"].count() == deduped.select("component_id").distinct().count()
    assert seen["substring_dedup"].count() == seen["near_dedup"].count()
    assert seen["substring_dedup"].agg(F.sum(words)).first()[0] < seen["near_dedup"].agg(F.sum(words)).first()[0]
    total = seen["substring_dedup"].agg(F.sum(words)).first()[0]
    assert seen["mixing"].agg(F.sum(words)).first()[0] == pytest.approx(1.5 * total, rel=0.01)
    assert seen["packing"].select("doc_id").distinct().count() == seen["mixing"].select("doc_id").distinct().count()
    final = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, at.select(final.columns).collect()))


@pytest.mark.parametrize("rows", [
    [], [(1, None, None), (None, "", "s")],
    [(None, "the cat sat on the mat and that was all there is to say", None)] * 3 + [(2, "the dog " * 30_000, "s"), (2, None, "s")]])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() >= 0 and "sequence_id" in out.columns
