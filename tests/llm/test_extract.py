import collections
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import extract, markup

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, text string, n_chars long, label int"


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


def texts(page):
    return [b[0] for b in markup.blocks(page, markup.Paths())]


def test_blocks():
    assert texts("<p>a <b>b<br>c</b>\n d<p>e</p>f<div>g<span>h</span></div>") == ["a b c d", "e", "f", "gh"]
    assert texts("x<!-- <p>y --><!--><p>z<!-- open") == ["x", "z"]
    assert texts("<script>var t='</p>';</script>a<style>p{}</style><title>t</title> b") == ["a b"]
    assert texts("<script>never closed <p>a") == [] and texts("a<svg/>b<iframe>c") == ["a b c"]
    assert texts("&lt;p&gt; &amp;amp; &eacute;&#233;&nbsp;x &bogus;") == ["<p> &amp; éé x &bogus;"]
    assert texts("<a title='x > y' href=z>q</a> 1 < 2 <p it's>don't</p><i a=\"open>r") == ["q 1 < 2", "don't", "r"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "c", "d", "1", "2", "3"]
    assert texts("") == [] and texts(" \n ") == [] and texts("<p></p><div> </div>") == []
    assert texts("</p></div>a</b><p>b</x") == ["a", "b"]


def test_paths():
    paths = markup.Paths()
    found = markup.blocks('<div class="post-Comments x"><p>a</p></div><div id=navMenu><a href=q>bb</a> c</div><p>d', paths)
    tokens = [{k for k in extract._tokens(paths, b[1])} for b in found]
    name = markup.token
    assert tokens[0] == {name(t) for t in ("t:div", "t:p", "c:post", "c:comments", "c:x")}
    assert tokens[1] == {name(t) for t in ("t:div", "c:nav", "c:menu")} and tokens[2] == {name("t:p")}
    assert [b[2] for b in found] == [0, 2, 0]
    marks = markup.blocks("<div data-main=1>a<div data-main=0>b</div>c</div>d", markup.Paths())
    assert [b[3] for b in marks] == [True, False, True, False]


def test_long_pages_take_linear_time():
    n = 60_000
    for page in ("<div>" * n + "x", "<b>" * n + "<p>x" * 100, "<i a=\"" * n + "x", "<svg>" * n + "x", "<!--" * n, "<p>x<b>" * n, "<a href='" * n, "</div>" * n + "x", "&amp" * n):
        markup.blocks(page, markup.Paths())
    assert len(texts("<p>a" * n)) == n


def test_words():
    found = ["Über x, über", "a", "longer " * 30 + "y"]
    rows, begins = extract.word_rows(found)
    assert begins.tolist() == [0, 3, 4] and len(rows) == 35

    def row(word):
        h = sum(b * int(extract._powers[min(i, 63)]) for i, b in enumerate(word.encode())) % 2**32
        return (h ^ h >> 15) % markup.ROWS

    assert rows.tolist() == [row(w) for t in found for w in t.lower().split()]


def test_recursion_against_plain_loop():
    m, rng = extract.Labeller(3), np.random.default_rng(0)
    x = rng.normal(size=(7, 1, extract.PATH + extract.WORD + extract.MEASURES)).astype(np.float32)
    for d in "fb":
        h = c = np.zeros(extract.UNITS)
        wanted = {}
        for t in range(7) if d == "f" else range(6, -1, -1):
            z = [sum(x[t, 0, k] * m.w[f"in_{d}"][k, j] for k in range(x.shape[2])) + sum(h[k] * m.w[f"re_{d}"][k, j] for k in range(extract.UNITS)) + m.w[f"b_{d}"][j] for j in range(4 * extract.UNITS)]
            gate = lambda v: 1 / (1 + np.exp(-np.array(v)))
            i, f, o, g = gate(z[: extract.UNITS]), gate(z[extract.UNITS : 2 * extract.UNITS]), gate(z[2 * extract.UNITS : 3 * extract.UNITS]), np.tanh(z[3 * extract.UNITS :])
            c = f * c + i * g
            h = o * np.tanh(c)
            wanted[t] = h
        padded, mask = np.concatenate([x, x])[:, [0, 0]], np.ones((14, 2, 1), np.float32)
        mask[7:, 0] = 0
        assert np.allclose(m.lstm(padded, mask, d)[:7, 0], [wanted[t] for t in range(7)], atol=1e-4)


def test_gradients_against_differences():
    m = extract.Labeller(5)
    rng = np.random.default_rng(2)
    m.w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in m.w.items()}
    made = extract.Layouts(["Some prose here, of a few words."], 3)
    batch = [extract.Sequence(made.page(["One text.", "Two words"]), None, True) for _ in range(3)]
    loss, grad = m.gradients(batch)
    for k in m.w:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old, moved = m.w[k][at], []
        for step in (1e-3, -1e-3):
            m.w[k][at] = old + step
            moved.append(m.gradients(batch)[0])
        m.w[k][at] = old
        assert grad[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-3, rel=0.05, abs=2e-5), k


def article(page):
    """What the tables' own pages hold between the tags of their article."""
    inner = page[page.find("<article>") + 9 : page.find("</article>")]
    found = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(x for x in found if x)


def test_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = extract.extract(pages, model)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    found = {r.page_id: r for r in got.collect()}
    rows = pages.collect()
    assert len(found) == len(rows) and all(found[r.page_id].n_chars == len(found[r.page_id].text) for r in rows)
    assert sum(found[r.page_id].text == article(r.html) for r in rows) >= 0.998 * len(rows)


def test_held_out_layouts(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 1000 and page_id < 1200").collect()
    bodies = [article(r.html).split("\n")[:40] for r in rows]
    made = extract.Layouts([t for b in bodies for t in b], 77)
    right = count = 0
    for b in bodies:
        page = made.page(b)
        found = markup.blocks(page, markup.Paths())
        kept = collections.Counter(model.main_text([page])[0].split("\n"))
        wanted = collections.Counter(t for t, _, _, main in found if main)
        count += len(found)
        right += len(found) - sum(((kept - wanted) + (wanted - kept)).values())
    assert right / count > 0.96


MADE = """<!doctype html><html><head><title>T</title></head><body class="home"><header class="site-header"><a href="/">Daily Paper</a></header>
<div id="cookie-banner"><p>We and our partners store cookies on your device, as the policy says.</p><button>OK</button></div>
<ul class="main-menu"><li><a href=1>News</a></li><li><a href=2>Sport</a></li></ul>
<div class="wrapper"><div class="article-body"><h1>A quiet harbour</h1><p>The boats came back at noon, and the town was still asleep.
<p>Nobody had expected so many fish &amp; so little wind.</p><div class="advert">Buy new shoes today, half the price of yesterday!</div>
<h2>Later</h2><ul><li>They sold it all.</li><li>Then they slept.</li></ul><p>It rained at night.</p></div>
<aside class="sidebar"><h3>Most read</h3><p>The mayor spoke about the new road for two hours, people say.</p></aside></div>
<div id="comments"><div class="comment"><p>I was there, and it was not quiet at all, believe me.</p></div><form><label>Your name</label><textarea>x</textarea></form></div>
<footer><p>&copy; Daily Paper. All rights reserved.</p></footer></body></html>"""


def test_page_unlike_those_learned_from(model):
    wanted = "A quiet harbour\nThe boats came back at noon, and the town was still asleep.\nNobody had expected so many fish & so little wind.\nLater\nThey sold it all.\nThen they slept.\nIt rained at night."
    assert model.main_text([MADE]) == [wanted]
    for old, new in (('class="article-body"', 'class="post-content"'), ("<div class=\"wrapper\">", "<main>"), ('id="comments"', 'class="reader-comments"'), ('class="advert"', 'class="sponsored box"')):
        assert model.main_text([MADE.replace(old, new)]) == [wanted]


def test_context_decides(model):
    """The same block with the same path is labelled by what stands around it."""
    x = np.zeros((5, 1, extract.PATH + extract.WORD + extract.MEASURES), np.float32)
    paths = markup.Paths()
    pages = ['<div class="content"><p>Some words of prose, as they come.</p></div>' * 3 + "<p>And one block more, of prose.</p>", '<div class="comment"><p>Some words of prose, as they come.</p></div>' * 3 + "<p>And one block more, of prose.</p>"]
    last = []
    for page in pages:
        found = markup.blocks(page, paths)
        x = model.inputs(found, paths, known := [np.zeros(extract.PATH, np.float32)])[:, None]
        last.append(float(model.logits(x, np.ones((len(x), 1, 1), np.float32))[-1, 0]))
        assert len(known) == len(paths.parent)
    assert abs(last[0] - last[1]) > 0.1


def test_awkward_pages(spark, model):
    long_ = "<html><nav><a>m</a></nav><article>" + "".join(f"<p>Paragraph {i} of a long text, with words.</p>" for i in range(30_000)) + "</article><footer>f</footer></html>"
    rows = [(1, "u", None, "t", 9, 1), (2, None, "", None, None, None), (None, "u", "<article><p>It is a text, of some words.</p><p>And another.</p></article>", None, None, None), (3, "u", long_, None, None, None), (3, "u", long_, None, None, None), (4, "u", "no tags", None, None, None), (5, "u", "<<<>>> </", None, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    got = extract.extract(df, model, keep=("url", "label")).collect()
    found = {(r.page_id, r.url): r for r in got}
    assert len(got) == len(rows) and found[1, "u"].text == "" == found[2, None].text and found[1, "u"].n_chars == 0
    body = "\n".join(f"Paragraph {i} of a long text, with words." for i in range(30_000))
    assert [r.text == body for r in got if r.page_id == 3] == [True, True]
    empty = spark.createDataFrame([], PAGES)
    untaught = extract.train(empty)
    assert extract.extract(empty, untaught).count() == 0 and extract.extract(df, untaught).count() == len(rows)
    assert extract.train(df.withColumn("html", F.lit("<p>a</p>"))).main_text(["", "<nav>x</nav>"])[0] == ""
