"""Language-model scoring and HTML extraction."""

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import html_extraction as H
from ledgerlens.llm.gru import Gru, Streams, classes, initial
from ledgerlens.llm.lm_scoring import END_ID, score_documents, words_of

ODD = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, " \t\n "), (4, "One one ONE"), (5, "w " * 20_000), (6, "é É")]


def model(seed=0, k=22, hidden=5):
    rng = np.random.default_rng(seed)
    counts = np.array([50.0, 20.0, *sorted(rng.integers(1, 30, k - 2).tolist(), reverse=True)])
    bounds = np.concatenate([[0, 1], 2 + classes(counts[2:], 4)])
    params = initial(counts, bounds, hidden)
    params["word_out"] = rng.normal(0, 0.3, params["word_out"].shape)
    params["class_out"] = rng.normal(0, 0.3, params["class_out"].shape)
    m = Gru(params, bounds)
    m.p = {n: v.astype(np.float64) for n, v in params.items()}
    return m, rng


def test_gradients_match_differences():
    m, rng = model()
    docs = [rng.integers(0, 22, n).astype(np.int32) for n in (7, 3, 12, 1, 5)]
    x, y, fresh, real, _ = next(Streams(docs, 1, 3).windows(12))
    mask, zero = real.T.ravel(), np.zeros((5, 3))

    def loss(grads=None):
        after, kept, _ = m.states(x, fresh, zero)
        score, back = m.output(m.rows(after)[mask], y.T.ravel()[mask], grads)
        if grads is not None:
            full = np.zeros((len(mask), 5))
            full[mask] = back
            m.backward(x, fresh, kept, full.reshape(len(after), 3, 5).transpose(0, 2, 1), grads)
        return -score.mean()

    grads: dict = {}
    loss(grads)
    for name, value in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old, step = value[at], 1e-4
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert (up - down) / (2 * step) == pytest.approx(grads[name][at], abs=2e-6)


def test_next_word_probabilities_sum_to_one_and_state_is_carried():
    m, rng = model()
    head = rng.integers(0, 22, 40).astype(np.int32)  # longer than a window
    base = m.score([head], END_ID)[0]
    total = sum(math.exp(m.score([np.append(head, w).astype(np.int32)], END_ID)[0] - base) for w in range(22))
    assert total == pytest.approx(1.0, abs=1e-6)
    alone = m.score([head], END_ID)[0]
    others = [rng.integers(0, 22, n).astype(np.int32) for n in (3, 90, 17, 1)]
    assert m.score([*others, head], END_ID)[-1] == pytest.approx(alone)


def test_training_learns_a_pattern():
    m, rng = model(hidden=8)
    m = Gru(m.p, m.bounds)
    docs = [np.array([2, 3, 4, 5] * 10 + [1], np.int32) for _ in range(200)]
    before = m.score(docs[:1], END_ID)[0]
    for _ in range(6):
        m.train(docs, END_ID)
    assert m.score(docs[:1], END_ID)[0] > before / 3


def plain_scores(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    return n, [(i, held[i], len(words_of(t)) + 1, sum(w in counts for w in [*words_of(t), b""]),
                round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words_of(t), b""]), 6)) for i, t in rows]


@pytest.mark.parametrize("rows,head", [(ODD, 1 << 16), (ODD + [(i, f"word{i % 9} word{i} and {i}") for i in range(10, 60)], 3)])
def test_base_scores_of_odd_rows(spark, rows, head):
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, words int, score double")
    out = score_documents(docs, listed=2, head_words=head, n_classes=2).collect()
    n, want = plain_scores(rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == Counter(want)
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in out)


def test_words_of_a_slice_are_cut_and_counted_without_a_python_word_each(monkeypatch):
    import pyarrow as pa

    from ledgerlens.llm import lm_scoring as L

    texts = [t for _, t in ODD[:-2]] + ["".join(map(chr, range(300))) * 2, "A\x0bB\x1cC\x85D\u2003E  f ", "é É", *[f"w{i % 40} w{i} W{i}" for i in range(300)]]
    cut = [L.words_of(t) for t in texts]
    monkeypatch.setattr(L, "words_of", None)  # not called for each text any more
    for some in (texts, [None], [" "], ["a"], texts[3:5]):
        for kind in (pa.string(), pa.large_string()):
            codes, words, n = L._words(pa.array(some, kind))
            names = words.to_pylist()
            parts = np.split([names[c] for c in codes], np.cumsum(n)[:-1]) if len(codes) else [[]] * len(some)
            assert [list(p) for p in parts] == [cut[texts.index(t)] if t in texts else [] if t == " " else [b"a"] for t in some]
    want = Counter(w for words in cut for w in [*words, b""])
    for size, table in ((1 << 20, 1 << 20), (200, 50)):
        monkeypatch.setattr(L, "SLICE", size)
        monkeypatch.setattr(L, "TABLE", table)
        got: Counter = Counter()
        for b in L._count(pa.RecordBatch.from_arrays([pa.array(t)], names=["text"]) for t in (texts[:100], texts[100:])):
            got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        assert got == want
    assert not sum(b.num_rows for b in L._count(iter([])))


def test_unseen_words_keep_their_embedding_and_its_sums():
    m, _ = model()
    m = Gru(m.p, m.bounds)
    before = m.p["embed"].copy()
    rows: list = []
    plain = m.backward
    m.backward = lambda *a: rows.append(plain(*a)) or rows[-1]
    m.train([np.array([2, 5, 2, 1], np.int32)], END_ID)
    assert [r.tolist() for r in rows] == [[1, 2, 5]]
    assert sorted(np.flatnonzero((m.p["embed"] != before).any(axis=1)).tolist()) == [1, 2, 5]


def test_scores_of_nothing_and_without_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = score_documents(only).first()
    assert (r.held_out, r.train_tokens, r.n_known) == (True, 0, 0) and math.isfinite(r.score)


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in score_documents(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens > sum(r.base_score for r in out) / tokens + 0.05
    assert np.mean([r.score > r.base_score for r in out]) > 0.85


@pytest.mark.parametrize("texts,listed", [([" ".join(f"w{i}" for i in range(3000))] * 2, 3000),
                                          ([" ".join(f"w{i}" for i in range(30_000))], 2046), (["a b b"], 2)])
def test_listed_words_follow_the_corpus(spark, monkeypatch, texts, listed):
    from ledgerlens.llm import lm_scoring

    seen = []
    monkeypatch.setattr(lm_scoring, "initial", lambda sizes, bounds, hidden: seen.append(sizes) or initial(sizes, bounds, hidden))
    out = score_documents(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), rounds=1)
    assert out.count() == len(texts) and len(seen[0]) == listed + 2


PAGE = """<html><head><title>x y</title><style>p{}</style></head><body class="page with-sidebar"><header><div class="logo">Site
Name</div></header><nav>Home About</nav><div id="cookie-notice">We use cookies on this site today</div>
<main><article><header><h1>Real &amp; title</h1></header><p>First   para of the <a href="x>y">story</a> has&nbsp;words.</p>
<aside class="related">Other stories you may like</aside><p>Second line<br>goes on <b>here<p>and on &lt;there&gt; it is.</p>
<div class="newsletter-signup"><form>Give us your mail <input name=a></form></div><ul><li>one item<li>two item</ul>
<script>if (a < b) "</p>"</script><!-- gone --><blockquote>Quoted words</blockquote></article>
<section id="comments"><h2>Comments</h2><p>I like this very much and think it is good</p></section></main>
<div class="sidebar"><p>Popular posts of the week are here</p></div><footer>&copy; all</footer></body></html>"""
TEXT = "\n".join(["Real & title", "First para of the story has words.", "Second line goes on here", "and on <there> it is.",
                  "one item", "two item", "Quoted words"])
WEIGHTS = {"p|0|0": 4.0, "h1|0|0": 4.0, "li|1|1": -2.0, "footer|0|1": -2.0, "<p": 4.0, "<nav": -2.0}


@pytest.mark.parametrize("page,text", [
    (PAGE, TEXT), (None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<p>open <b>tags", "open tags"), ("<p>x<!-- never closed", "x"), ("<p>x<script>never closed", "x"), ("<nav>a b</nav>", ""),
    ("<div class=comments>no</div><p>yes it is", "yes it is"), ("<P CLASS='x'>UP &#233;&eacute;&unknown;", "UP éé&unknown;"),
    ("<p>" + "long text " * 30_000, ("long text " * 30_000).strip())])
def test_extraction(page, text):
    assert H.extract(page, WEIGHTS) == text


@pytest.mark.parametrize("page,text", [
    ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', "one two\nthree"),
    ("<p>one <svg><title>t</title><g>no</g></svg> two</p><p>three", "one two\nthree"),
    ("<p>one <button>no <p>two</p><p>three <button>no</button> four", "one\ntwo\nthree four"),
    ("<p>one<select><option>no<option>no</p><p>two", "one\ntwo"), ("<p>one <object><p>no</p><object>no</object></object> two", "one two"),
    ("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is</p>", "as x=2 is"), ("<p>x<script>a <p>b", "x")])
def test_elements_without_text_end_where_they_end(page, text):
    assert H.extract(page, WEIGHTS) == text


LONG = "<p>" + "some words of the story " * 20 + "</p>"


@pytest.mark.parametrize("page,text", [
    (f'<div class="content sidebar-right"><article>{LONG}</article></div>', H.SPACE.sub(" ", LONG[3:-4]).strip()),
    (f'<div id="page" class="site header-fixed"><p>one</p>{LONG}<div class="share">no no</div></div>', "one\n" + LONG[3:-4].strip()),
    (f'<article><h2 id="related-work">Related work</h2>{LONG}<h2 id="search">Search</h2>{LONG}</article>',
     "\n".join(["Related work", LONG[3:-4].strip(), "Search", LONG[3:-4].strip()])),
    (f'<article>{LONG}<div class="promo"><p>buy</p></div>{LONG}</article>', "\n".join([LONG[3:-4].strip()] * 2))])
def test_names_do_not_take_the_article(page, text):
    assert H.extract(page, WEIGHTS) == text


@pytest.mark.parametrize("words", [20, 45, 200])
@pytest.mark.parametrize("tag", ["aside", 'div class="promo"', "form"])
def test_long_blocks_apart_do_not_end_an_article(words, tag):
    page = f"<nav>a b</nav><article>{LONG}<{tag}><p>{'no ' * words}</p></{tag.split()[0]}><p>short last words</p></article><footer>c d</footer>"
    assert H.extract(page, WEIGHTS) == LONG[3:-4].strip() + "\nshort last words"


TALK = "<p>I like this very much</p><div><p>me too and more</p></div>"


@pytest.mark.parametrize("page,text", [
    (f"<body><article>{LONG}</article><h2>Comments</h2>{TALK}</body>", LONG[3:-4].strip()),
    (f"<div><p>one</p>{LONG}<h3>2 <b>comments</b></h3>{TALK}</div>", "one\n" + LONG[3:-4].strip()),
    (f"<article>{LONG}<h3>Comments (2)</h3>{TALK}<h3>Sources</h3><p>the last part</p></article>", LONG[3:-4].strip() + "\nSources\nthe last part"),
    (f"<article>{LONG}<section><h2>Leave a reply</h2>{TALK}</section><p>the last part</p></article>", LONG[3:-4].strip() + "\nthe last part"),
    (f"<article><h2>Comments</h2>{LONG}</article>", "Comments\n" + LONG[3:-4].strip()),  # most of the page
    (f"<article><h1>Comments on the budget</h1>{LONG}<h2>Comments and notes</h2><p>kept words</p></article>",
     "\n".join(["Comments on the budget", LONG[3:-4].strip(), "Comments and notes", "kept words"]))])
def test_comments_marked_by_a_heading_only(page, text):
    assert H.extract(page, WEIGHTS) == text


def test_learned_weights_of_names_decide(spark):
    page = f'<article>{LONG}<div class="notice">{"kept words " * 9}</div>{LONG}</article><div class="promo">{"buy now " * 9}</div>'
    weights = H.fit(spark.createDataFrame([(page,)] * 3, "html string"))
    assert weights["@notice"] > 0 > weights["@promo"]
    assert H.extract(page, weights) == "\n".join([LONG[3:-4].strip(), ("kept words " * 9).strip(), LONG[3:-4].strip()])


def test_pages_of_odd_rows(spark):
    rows = [(i, "u", p, "x", 3) for i, p in enumerate([PAGE, PAGE, None, ""])] + [(None, None, PAGE, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = H.main_text(pages, weights=WEIGHTS).collect()
    assert [(r.text, r.n_chars) for r in out] == [(TEXT, len(TEXT))] * 2 + [("", 0)] * 2 + [(TEXT, len(TEXT))]
    assert H.main_text(pages.limit(0)).count() == 0
    assert H.main_text(pages).count() == 5


def test_weights_learned_from_labelled_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    weights = H.fit(pages)
    assert weights["p|0|0"] > 1 and weights["li|1|1"] < -1 and weights["footer|0|1"] < -1
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in H.main_text(pages).collect():
        inner = rows[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\n", inner.replace("<br>", " "))).split("\n")
        assert r.text == "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
