import random

import pytest

from stforecast.llm import page_text as P
from stforecast.llm.shared import table


@pytest.fixture(scope="module")
def model(spark):
    return P.learn(table(spark, "/root/testdata/sf0.01", "pages"))


def test_pages_that_mark_their_article(spark, model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in P.extract(pages, model).collect()}
    same = total = 0
    for row in pages.collect():
        want = " ".join(b.text for b in P.blocks_of(row.html) if P.marked(b))
        same, total = same + (got[row.page_id] == want), total + 1
    assert same / total >= 0.99


def test_pages_in_other_dress(spark, model):
    """Held-out pages with other containers and with blocks of every other kind."""
    rows = table(spark, "/root/testdata/sf0.001", "pages").collect()
    parsed = [P.blocks_of(r.html) for r in rows]
    pool = [b.text for blocks in parsed for b in blocks if len(b.text) < 600]
    draw, wrong, total = random.Random(11), 0, 0
    work = P.Extractor(model)
    for blocks in parsed * 3:
        shown, labels = P.dressed(blocks, [P.marked(b) for b in blocks], pool, draw)
        gains = [
            work.chain_gain(b.chain) + sum(model.weights.get(f, 0.0) for f in fs)
            for b, fs in zip(shown, P.text_features(shown), strict=True)
        ]
        wrong += sum(a != b for a, b in zip(P.viterbi(gains, model), labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.01


def test_a_page_of_unknown_make(model):
    page = """<html><body><div class="site-header"><h2>My Site</h2></div><div id="cookie-notice">We use cookies.</div>
    <div class="main-content"><h1>Title here</h1><p>First paragraph of the article, with words &amp; more.</p>
    <p>Second paragraph, quite long,\n with <a href=x>a link</a> and <b>bold</b> text.</p></div>
    <div class="sidebar"><ul><li><a href=1>Related</a></li></ul></div>
    <div class="comments"><p>Nice article, I like it.</p></div><form><label>Name</label></form><footer>2020</footer>"""
    assert P.Extractor(model).text(page) == (
        "Title here First paragraph of the article, with words & more."
        " Second paragraph, quite long, with a link and bold text."
    )


def test_blocks():
    html = "<title>t</title><p>a&nbsp;&lt;b&gt;<b>c</b>\n\n d<p>e<br>f<script>var x='<p>no</p>'</script><style>p{}</style><!-- no --><li>g"
    assert [b.text for b in P.blocks_of(html)] == ["a <b>c d", "e f", "g"]
    assert P.blocks_of(None) == P.blocks_of("") == P.blocks_of("<div></div>") == []
    assert [b.text for b in P.blocks_of("<p>open <b>never closed <p>next <a href='x'>link")] == ["open never closed", "next link"]
    assert P.blocks_of("<p>x<a>yz</a></p>")[0].linked == 2
    assert [b.text for b in P.blocks_of("<head><title>no<body>yes")][-1:] in ([], ["yes"])
    P.blocks_of("<" * 2000 + "&#xFFFFFFFF; <a <b <!-- " + "<div>" * 500)


@pytest.mark.parametrize("start", ["<p>", "<div>", "<b>", "<h1>", "", "<br>"])
def test_a_head_that_is_not_closed(start):
    inside = "<meta charset=x><script>no</script><noscript><img src=x>no</noscript><template><p>no</p></template><title>no</title>\n"
    assert [b.text for b in P.blocks_of(f"<html><head>{inside}{start}yes <p>more")] == ["yes", "more"]
    assert [b.text for b in P.blocks_of(f"<html><head>{inside}</head>{start}yes <p>more")] == ["yes", "more"]


def test_odd_pages(spark, model):
    long = "<article>" + "<p>some more words of the text.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Some words here.</p></article>", "x"),
            (4, "u", long, "x"), (4, "u", "<nav><ul><li><a href=x>Home</a></li></ul></nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in P.extract(pages, model).collect()]
    assert got[:2] == [(1, "", 0), (2, "", 0)] and got[2] == (None, "Some words here.", 16)
    assert got[3][1] == " ".join(["some more words of the text."] * 20_000) and got[4][1:] == ("", 0)
    assert all(len(text) == n for _, text, n in got)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = P.learn(none)
    assert P.extract(none, model).count() == 0 and P.Extractor(model).text("<p>text</p>") in ("", "text")


def test_the_few_pages_that_mark_their_article_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE_PAGES", 3)
    marked = "<html><body><ul><li>Menu</ul><ARTICLE class=x><p>Words of the article.</p></ARTICLE></body></html>"
    rows = [(i, marked if i in (50, 51) else f"<div>plain page {i}</div>") for i in range(100)]
    assert P.learn(spark.createDataFrame(rows, "page_id long, html string")).weights


def test_viterbi_finds_the_best_labels():
    draw = random.Random(2)
    for _ in range(40):
        model = P.Model({}, [[draw.gauss(0, 1) for _ in range(2)] for _ in range(2)], draw.gauss(0, 1))
        gains = [draw.gauss(0, 1) for _ in range(7)]

        def score(labels, model=model, gains=gains):
            steps = sum(model.step[a][b] for a, b in zip(labels, labels[1:], strict=False))
            return steps + sum(g for g, x in zip(gains, labels, strict=True) if x) + model.first * labels[0]

        best = max(([k >> i & 1 for i in range(7)] for k in range(128)), key=score)
        assert P.viterbi(gains, model) == best
    assert P.viterbi([], P.Model({}, [[0, 0], [0, 0]], 0)) == []
