"""Per-text operators against plain versions: quality statistics, tokens, packing, language, toxicity, HTML."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from cauldron.llm import htmltext, langid, packing, pretokens, quality, queries, tokencount, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\n", "one", "a b c d e f g h i j", "x " * 30, "same line here\nsame line here\n",
             "\x00 \x1c \x85  nbsp", "日本語 テキスト", "é́ ß ſ", "<|endoftext|> mid <|endoftext|>", "word " * 40_000]
NEEDED = ("doc_id", "text", "lang", "source")


@pytest.fixture()
def odd(spark):
    """Null ids, null and very long texts, repeated rows and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, None, 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, n_words string")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, quality int, toxic int")


def plain_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|\x0b ", max_size=60)), max_size=6))
def test_quality_statistics_equal_the_plain_ones(texts):
    got, _ = quality.statistics(pa.array(texts, pa.string()))
    assert [tuple(r) for r in got.tolist()] == [plain_statistics(t) for t in texts]


def test_quality_verdicts(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, quality.fit(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.base_failed == ((got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words))).all()
    assert not got[got.base_failed].kept.any()
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.97
    assert judged[judged.quality == 0].kept.mean() < 0.15
    forest = quality.fit(docs, labels)
    rows = quality.judge(odd, forest).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and all(r.kept is not None for r in rows)
    assert quality.judge(nothing, forest).count() == 0
    unjudged = quality.judge(odd, quality.fit(odd, nothing)).collect()
    assert all(r.kept == (not r.base_failed) for r in unjudged)


def test_calibration_keeps_good_rows():
    score = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9])
    bad = np.array([False, False, False, False, True, True])
    assert 0.4 <= quality.calibrate(score, bad, 0.0) < 0.8
    assert quality.calibrate(score, np.zeros(6, bool), 0.0) == float("inf")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    return path, Tokenizer.from_file(path)


def test_pretokens_give_the_librarys_ids(tokenizer):
    path, library = tokenizer
    rnd = random.Random(5)
    bits = ["a", "b", "é", "ß", "1", "٣", "²", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "'", "''", "'s",
            "'re", "'ll", "'x", "!", "…", "日本", "🙂", "‍", "́", "_", "<|endoftext|>", "<|end", "\x00"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(4000)] + [""]
    split = pretokens.PreTokens(path, cache_size=64)  # small enough to be emptied again and again
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in split.ids(texts)] == want


@pytest.mark.parametrize("sizes", [{}, {"table_size": 3, "summary_size": 2}])
def test_token_counts(spark, odd, nothing, tokenizer, sizes):
    path, library = tokenizer
    got = tokencount.count_tokens(odd, path, **sizes).toPandas()
    want = odd.toPandas()
    ids = [len(library.encode(t or "", add_special_tokens=False).ids) for t in want.text]
    assert got.n_tokens.tolist() == ids
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in want.text]
    assert got.over_limit.tolist() == [n > 1024 for n in ids]
    assert tokencount.count_tokens(nothing, path).count() == 0


def test_frequent_pretokens_of_many_summaries(spark, tokenizer, monkeypatch):
    path, library = tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(30)
    split = pretokens.load(path)
    codes, distinct, _ = split.split([r.text for r in docs.collect()])
    counts = sorted(zip(np.bincount(codes).tolist(), distinct.to_pylist()), reverse=True)
    assert tokencount.frequent(docs, path, 1 << 20, 1 << 20).keys() == {t for _, t in counts}
    monkeypatch.setattr(tokencount, "FAN_IN", 3)  # rounds of 30, 10, 4 and 2 summaries
    assert tokencount.frequent(docs, path, 1 << 20, 1 << 20).keys() == {t for _, t in counts}
    few = tokencount.frequent(docs, path, 200, 100)  # short summaries still find the most frequent
    assert len(few) == 200 and {t for _, t in counts[:20]} <= few.keys()
    assert all(n == len(library.encode(t.decode(), add_special_tokens=False).ids) for t, n in few.items())


def check_packed(packed, docs, library, length=1024):
    ids = {}
    for r in docs.itertuples():
        ids[r.doc_id] = library.encode(r.text or "", add_special_tokens=False).ids + [2]
    for r in packed.itertuples():
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
    for _, sequence in packed.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]]
        assert sequence.length.sum() <= length
    for doc, mine in packed.sort_values("piece").groupby("doc_id"):
        assert mine.piece.tolist() == list(range(len(mine)))
        assert mine.length.sum() == len(ids[doc]) and (mine.length[1:] == length).all()
        assert len(mine) == 1 or len(ids[doc]) > length


def test_packing(spark, odd, nothing, tokenizer):
    path, library = tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(docs, path)
    found = packed.toPandas()
    check_packed(found, docs.toPandas(), library)
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 1024 + 1
    again = packing.pack(docs.repartition(7), path).toPandas()
    key = ["doc_id", "piece"]
    assert found.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    some = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packed(packing.pack(some, path, group_pieces=3).toPandas(), some.toPandas(), library)
    assert packing.pack(odd, path).where("doc_id IS NULL").count() == 1
    assert packing.pack(nothing, path).count() == 0


def test_open_bins_bound_what_best_fit_holds(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = [r.length for r in packing.pieces(docs, tokenizer[0]).collect()] * 4
    random.Random(1).shuffle(lengths)
    least = sum(lengths) / 1024
    used = [max(packing.best_fit(lengths, 1024, n)[0]) + 1 for n in (1, 8, packing.OPEN_BINS)]
    assert used[0] > used[1] > used[2] and used[2] <= 1.03 * least


def test_packing_spreads_rows_repeated_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    found = spark.range(400).selectExpr("CAST(NULL AS bigint) doc_id", "0 piece", "0L start", "600L length", "7L ids_crc32")
    packed = packing.pack_pieces(found, group_pieces=40).toPandas()
    assert len(packed) == 400 and packed.sequence_id.nunique() == 400
    assert (packed.sequence_id.to_numpy() >> 32).max() == 9
    assert packed.groupby(packed.sequence_id.to_numpy() >> 32).size().max() < 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_best_fit_equals_a_plain_scan(lengths, open_bins):
    bins, offsets = packing.best_fit(lengths, 16, open_bins)
    free, opened, want = {}, [], []
    for n in lengths:
        holds = [b for b in opened if free[b] >= n]
        least = min((free[b] for b in holds), default=None)
        if least is None:
            at = len(free)
            free[at] = 16
        else:
            at = next(b for b in holds if free[b] == least and b == bins[len(want)]) if any(
                free[b] == least and b == bins[len(want)] for b in holds) else -1
            opened.remove(at)
        want.append((at, 16 - free[at]))
        free[at] -= n
        if free[at]:
            opened.append(at)
            if len(opened) > open_bins:
                fullest = min(free[b] for b in opened)
                opened.remove(next(b for b in opened if free[b] == fullest))
    assert list(zip(bins, offsets)) == want


def test_language_on_held_out_rows(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unseen = langid.held_out()
    filters = langid.fit(docs.where(~unseen))
    got = langid.identify(docs, filters).select("*", unseen.alias("h")).toPandas().merge(
        docs.select("doc_id", "lang").toPandas(), on="doc_id")
    want = {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    assert set(got[got.h].doc_id) == want
    assert (got[got.h].lang == got[got.h].lang_pred).mean() > 0.97
    rows = {r.doc_id: r for r in langid.identify(odd, filters).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[3].lang_pred == "und" and rows[0].score == 0
    assert rows[9].lang_pred in filters.languages
    assert langid.identify(nothing, filters).count() == 0
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    kept = langid.keep_identified(odd, filters)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 0 and kept.where("doc_id = 5").count() <= 3
    assert langid.keep_identified(docs, filters).count() > 0.98 * docs.count()


def test_unlearned_languages_and_random_letters_are_rejected(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = docs.where(~langid.held_out())
    filters = langid.fit(labelled)
    share = langid.least_share(labelled, filters)
    texts = [(r.text, r.lang) for r in labelled.collect() if r.text and r.lang]
    total, hits = filters.explained([t for t, _ in texts])
    plain = np.sort((hits.max(1) / np.maximum(total, 1))[total > 0])
    assert share == pytest.approx(0.5 * plain[int(np.ceil(0.01 * len(plain))) - 1], abs=0.0006)
    rnd = random.Random(4)
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
               "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
               "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    foreign += [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
                         for _ in range(60)) for _ in range(50)]
    planted = spark.createDataFrame([(-i, t) for i, t in enumerate(foreign, 1)], "doc_id long, text string")
    assert langid.keep_identified(planted, filters, share).count() == 0
    assert langid.keep_identified(docs, filters, share).count() >= 0.995 * docs.count()
    assert langid.least_share(nothing, filters) == 0.0 and langid.least_share(docs, langid.fit(nothing)) == 0.0


def test_bloom_slices_answer_membership():
    rnd = np.random.default_rng(3)
    members = {f"l{i:02d}": rnd.integers(0, 2 ** 63, 500).astype(np.uint64) for i in range(11)}  # two slices
    filters = langid.Filters(members, "l00")
    for i, (lang, codes) in enumerate(sorted(members.items())):
        mask = np.full(len(codes), 255, np.uint8)
        for slot in langid._slots(codes):
            mask &= filters.slices[i // 8][slot]
        assert (mask >> (i % 8) & 1).all()
    assert (filters.false_rate < 1e-4).all()


def test_toxicity_gradients():
    model = {k: v.astype(np.float64) for k, v in toxicity.start(1).items()}
    words = toxicity.Words(pa.array(["you are a b cc ddd eeee fffff", "x y z", ""], pa.string()))
    inputs, blank = toxicity.Inputs(words.distinct.to_pylist()), len(words.distinct)
    codes, _ = toxicity.windows(words.counts, words.rows, words.codes, blank)
    slope = np.array([0.5, -1.0, 0.25])

    def total():
        return (toxicity.forward(model, inputs.vectors(model).astype(float), codes, blank)[0] * slope).sum()

    x = inputs.vectors(model).astype(float)
    _, kept = toxicity.forward(model, x, codes, blank, keep=True)
    found = toxicity.backward(model, x, inputs, kept, slope)
    for name, value in model.items():
        at = np.unravel_index(np.abs(found[name]).argmax(), value.shape)
        old, step = value[at], 1e-2
        value[at] = old + step
        high = total()
        value[at] = old - step
        low = total()
        value[at] = old
        assert found[name][at] == pytest.approx((high - low) / (2 * step), rel=0.02, abs=1e-4), name


def test_toxicity_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        codes, row = toxicity.windows(np.array([n]), np.array([0, n]), np.arange(n), n)
        assert set(codes.ravel().tolist()) - {n} == set(range(n)) and (row == 0).all()


def test_toxicity_learns_and_scores_whole_texts(spark, odd, nothing):
    rnd = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(240):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 200))]
        bad = i % 3 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), "vile")
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id < 180"), docs)
    got = toxicity.score(docs, model).toPandas()
    unseen = got[got.doc_id >= 180]
    assert ((unseen.score >= 0.7) == (unseen.doc_id % 3 == 0)).mean() > 0.95
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(nothing, model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, nothing)).collect()} == {0.0}


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plain(source):
        m = re.search(r"(?s)<article>(.*?)(</article>|$)", source)
        marked = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\x00", m.group(1)))
        return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in marked.split("\x00")) if t)

    got = htmltext.extract(pages).toPandas().merge(pages.toPandas(), on="page_id")
    assert (got.text == got.html.map(plain)).all() and (got.n_chars == got.text.str.len()).all()


LAYOUT = """<html><body><div id="header"><a href=x>Home</a></div>
<div class="sidebar"><p>side text that is long enough to look like content, really it is</p></div>
<div><div><h2>Title</h2><p>First para with some <b>bold</b>text, long enough to be content of the page.</p>
<p>Second para with &amp; and <a href=y>a link</a> inside it &nbsp; ok.</p></div></div>
<div class="cookie-notice">We use cookies on this site to make it better for you</div>
<section id=comments><h3>Comments</h3><p>reader one says great</p></section><footer>c</footer></body></html>"""


@pytest.mark.parametrize("source, want", [
    ("<html><body><article><p>The area is <math><msup><mi>r</mi><mn>2</mn></msup><mo>&#960;</mo><semantics><mi>x</mi>"
     "<annotation encoding='application/x-tex'>r^2</annotation></semantics></math> units</p></article></body></html>",
     "The area is r2πx units"),
    (LAYOUT, "Title First para with some boldtext, long enough to be content of the page. "
             "Second para with & and a link inside it ok."),
    ("<body><main><header><h1>Head</h1></header><section><p>one one one one</p><p>two</p></section><section><p>three"
     "</p></section><form>Subscribe</form><div class=ads>Buy</div></main><p>outside</p>", "Head one one one one two three"),
    ("<article class='post has-comments'><p>text</p><div class='no-sidebar'>more</div></article>", "text more"),
    ("just text < 5 & more", "just text < 5 & more"), ("<p>a<p>b<script>x</p>", "a b"), ("<div>", ""), ("", ""), (None, ""),
    ("<p>cut &am", "cut &am"), ("<p>open tag <a href='", "open tag"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"), ("<p>x" * 3000, " ".join(["x"] * 3000)),
    ("<div>" * 5000 + "deep", "deep"),
])
def test_page_layouts(source, want):
    assert htmltext.main_text(source) == want


def paragraphs(word, k, words=40):
    return f"<p>{' '.join([word * 5] * words)}</p>" * k


@pytest.mark.parametrize("source, words", [
    ("<body><div class=wrap><div>{a3}</div><div>{b3}</div></div>", (3, 3, 0)),
    ("<html><div><section>{a8}</section><section>{b2}</section><section>{c3}</section></div></html>", (8, 2, 3)),
    ("<body><div><div><section>{a9}</section></div><div><h2>h</h2>{b2}</div>{c1}</div>", (9, 2, 1)),
    ("<body><div><div>{a5}</div><div>" + "bbbbb " * 120 + "<ul><li>one<li>two</ul></div></div>", (5, 3, 0)),
    ("<body><div><div>{a5}</div><p>" + "bbbbb " * 40 + "<span><i>x</i> <i>yy</i></span></p></div>", (5, 1, 0)),
    ("<body><div><div>{a3}</div><div>" + "<a href=x>bbbbb ccccc</a> " * 40 + "</div></div>", (3, 0, 0)),  # links stay out
])
def test_siblings_below_a_wrapper(source, words):
    page = source.format(**{f"{w}{k}": paragraphs(w, k) for w in "abc" for k in range(10)})
    found = Counter(htmltext.main_text(page).split())
    assert tuple(found[w * 5] for w in "abc") == tuple(40 * k for k in words)


@pytest.mark.parametrize("kept", [
    '<h2 id="related-work">{}</h2>', '<h2 id="comments">{}</h2>', '<p id="notice-period">{}</p>',
    '<section id="hidden-costs"><h2>{}</h2><p>x</p></section>', '<div id="login-flow"><p>{}</p><p>x</p></div>',
    '<p class="byline">{}</p>', '<div class="breadcrumb">{}</div>', '<div class="overflow-hidden"><p>{}</p></div>'])
@pytest.mark.parametrize("page", ["<article>{}{}</article>", "<main><div>{}</div>{}</main>", "<div><div>{}{}</div></div>"])
def test_slugs_keep_their_text(page, kept):
    text = " ".join(["word"] * 20)
    assert "here " + text in htmltext.main_text(page.format(paragraphs("a", 2, 9), kept.format("here " + text)))


@pytest.mark.parametrize("page", ["<article>{}{}</article>", "<div><div>{}{}</div></div>"])
@pytest.mark.parametrize("cut", [
    '<div id="comments"><p>{}</p></div>', '<section id="related-posts">{}</section>', '<div class="site-footer-2">{}</div>',
    '<div id="cookie-notice">{}</div>', '<div class="post-comments-list"><p>{}</p></div>', '<div id="div-gpt-ad-12">{}</div>',
    '<ul class="breadcrumbs"><li><a href=x>{}</a></ul>', '<div id="our-related-reads"><a href=x>{}</a></div>',
    '<span class="x-share-y"><a href=x>{}</a></span>'])
def test_named_boilerplate_goes(page, cut):
    got = htmltext.main_text(page.format("<p>" + "text " * 30 + "</p>", cut.format("gone " * 8) + "<p>" + "more " * 30))
    assert "gone" not in got and got.count("text") == got.count("more") == 30 and "textmore" not in got


def test_a_box_that_holds_the_page_stays():
    page = "<body><div class='content-sidebar-wrap'>{}<div class='x-sidebar-y'><i>s</i><i>t</i></div></div>"
    assert htmltext.main_text(page.format(paragraphs("a", 4))).split() == ["aaaaa"] * 160


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (1, "u", "<p>a"), (1, "u", "<p>a")],
                                  "page_id long, url string, html string")
    assert sorted(r.text for r in htmltext.extract(pages).collect()) == ["", "a", "a", "a"]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_repeated_labelled_ids_stay_bounded(spark):
    from cauldron.llm.quality import labelled_rows

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "two"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    rows = labelled_rows(docs, labels, "toxic", 10).collect()
    assert sorted((r.doc_id, r.toxic) for r in rows) == [(1, 0), (2, 1), (3, 1)]
    again = labelled_rows(docs.repartition(5), labels, "toxic", 10).collect()
    assert {r.doc_id: r.text for r in rows} == {r.doc_id: r.text for r in again}
    assert len(labelled_rows(docs, labels, "toxic", 1).collect()) == 1
