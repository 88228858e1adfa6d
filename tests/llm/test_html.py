"""HTML extraction: trees of odd markup, messages against enumeration, whole tables."""

import itertools
import re
from html import unescape

import numpy as np
import pytest

from trialspark.llm import html_extract as H
from trialspark.llm import labelled_pages
from trialspark.llm.common import table
from trialspark.llm.html_tree import parse


@pytest.fixture(scope="module")
def model():
    return H.fit()


def leaves(html):
    t = parse(html)
    return [(t.tag[t.parent[i]], x) for i, x in enumerate(t.text) if x is not None]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("plain &lt;b&gt; &amp text &#233;&#xe9;", [("body", "plain <b> & text éé")]),
        ("<p>one<p>two<div>three</p>four</div>", [("p", "one"), ("p", "two"), ("div", "three"), ("div", "four")]),
        ("<p><b>a <i>b</b>\n\t c</i><br>d", [("p", "a b c d")]),
        ("a<!-- <p>x</p> -->b<!--> c <!-- d", [("body", "ab c")]),
        ("<script>var t='</p><p>';</script>x<style>p{}</STYLE >y<textarea><p>z</textarea><title>t</title>", [("body", "xy")]),
        ("<SCRIPT>no end", []),
        ("<div class='a>b' title=\"<p>\">x</div>", [("div", "x")]),
        ("<div class='open>x</div>y", [("div", "x"), ("body", "y")]),
        ("x<div class=", [("body", "x")]),
        ("a < b <3 c", [("body", "a < b <3 c")]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("body", "e")]),
        ("<table><tr><td>a<td>b<tr><td><div>c</td></tr></table>d", [("td", "a"), ("td", "b"), ("div", "c"), ("body", "d")]),
        ("<div><article><p>a</div>b</article>c", [("p", "a"), ("body", "b"), ("body", "c")]),
        ("<form><select><option>a<option>b</select><button>c</button>d</form>", [("form", "d")]),
        ("<div><select><option>a</div><p>b", [("p", "b")]),
        ("<![CDATA[a & b]]> c<?php x ?></ >d", [("body", "a & b cd")]),
        ("</p></div></li>x<h1>a<h2>b</h3>c", [("body", "x"), ("h1", "a"), ("h2", "b"), ("body", "c")]),
    ],
)
def test_trees_of_any_markup(html, want):
    assert leaves(html) == want


def test_names_and_links_of_a_tree():
    t = parse('<div CLASS="siteNav main-menu" id=x1 hidden><a href="/">abc <p>de</a></p> f')
    assert t.words[1] == ["site", "nav", "main", "menu", "x", "hidden"] and t.text[2] == "abc" and t.linked[2] == 3 and t.linked[4] == 2 and t.linked[5] == 0


def test_deep_and_long_pages_end():
    assert leaves("<div>" * 3000 + "x" + "</span>" * 3000) == [("div", "x")]
    assert len(leaves("<p>" + "word " * 200_000)[0][1]) == 999_999
    assert leaves('<a "' * 20_000) == [] and leaves("<a <p" * 20_000) == []


def test_messages_give_the_marginals_of_enumeration():
    rng = np.random.RandomState(2)
    tree = parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
    nodes = H.describe([tree])
    m = H.Model(rng.normal(0, 1, H.SIZE), rng.normal(0, 1, (H.KINDS**2, 2, 2)))
    n = len(tree.tag)
    own = np.bincount(nodes.at, m.weights[nodes.feature], n)
    single, pair, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(m.tables[nodes.edge[i], y[nodes.parent[i]], y[i]] for i in range(1, n)))
        total += w
        single += w * np.array(y)
        for i in range(1, n):
            pair[i, y[nodes.parent[i]], y[i]] += w
    got, edges = H.propagate(nodes, m)
    assert np.allclose(got, single / total) and np.allclose(edges[1:], pair[1:] / total)


def test_training_takes_what_labels_say(model):
    wrong = pages = 0
    for page in labelled_pages.pages(6, seed=77):  # other words and names than the model's
        want = [x.replace(labelled_pages.MARK, "") for _, x in leaves(page) if labelled_pages.MARK in x]
        wrong += H.texts([page.replace(labelled_pages.MARK, "")], model) != ["\n".join(want)]
        pages += 1
    assert wrong <= 0.04 * pages, (wrong, pages)


def test_layouts_of_its_own(model):
    para = "<p>La phrase est longue, elle a des mots. Une autre suit, plus courte.</p>"
    page = f"""<!doctype html><html><head><title>Site</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="home">
    <div class="cookie-banner"><p>We use cookies. Accept them all, or read more about it.</p><button>OK</button></div>
    <header id="masthead"><a href="/">Site</a><form action="/s"><input name=q><button>Search</button></form></header>
    <nav class="main-nav"><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></nav>
    <main><article class="post"><h1>Un titre &amp; plus</h1>{para}<div class="advert"><p>Buy now, the best of all offers.</p></div>{para}<ul><li>premier point<li>deuxième point</ul>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>I think this is wrong. Really.</p></div></section></article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=3>Other story</a></ul></aside>
    <footer><p>&copy; 2024 Site. All rights reserved.</p></footer></body></html>"""
    text = "La phrase est longue, elle a des mots. Une autre suit, plus courte."
    assert H.texts([page], model) == [f"Un titre & plus\n{text}\n{text}\npremier point\ndeuxième point"]


def plain(html):
    """The text by the generator's own tags, for the given tables alone."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (re.sub(r"\s+", " ", unescape(b.replace("<br>", " ").replace("<b>", ""))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_every_page_of_the_table(spark):
    from trialspark.llm.queries import op11_html_extract

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op11_html_extract(spark, sf).collect()}
    rows = table(spark, sf, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


def test_odd_rows(spark, model):
    page = "<nav>a</nav><article><h1>Titre</h1><p>Une phrase.</p></article>"
    rows = [(1, "u", page, "x", 3), (1, "u", page, "y", 4), (None, None, page, None, None), (2, "v", None, "", 0), (3, None, "", "", 0), (4, "w", "<p> </p><script>x</script>", "", 0), (5, "z", "<article><p>" + "mot " * 100_000 + ".</p></article>", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.text[:20], r.n_chars) for r in H.extract(df, model).collect()))
    assert got == [(0, "Titre\nUne phrase.", 17), (1, "Titre\nUne phrase.", 17), (1, "Titre\nUne phrase.", 17), (2, "", 0), (3, "", 0), (4, "", 0), (5, "mot mot mot mot mot ", 400_001)]
    assert H.extract(df.where("false"), model).count() == 0
    assert H.texts([page], H.fit(df.where("false"))) == ["Titre\nUne phrase."]
