from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import html_text

WORDS = "river stone garden letter window market silver morning teacher bridge yellow little bottle".split()


def page(rng, n, paragraphs=3):
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + "."
    body = "".join(f"<p>{say(rng.randint(8, 60))}</p>" for _ in range(paragraphs))
    nav = "".join(f'<li><a href="/{k}">{rng.choice(WORDS)}</a></li>' for k in range(5))
    return (
        f"<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul>{nav}</ul></nav>"
        f'<div class="ad">{say(6)}</div><article><h1>{say(4)}</h1>{body}</article><footer>&copy; {say(5)}</footer></body></html>'
    )


@pytest.fixture(scope="module")
def trained(spark, checkpoint_folder):
    rng = random.Random(6)
    rows = [(i, f"http://x/{i}", page(rng, i, rng.randint(1, 6))) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return pages, html_text.train(pages)


def marked(dom):
    inside = np.array(dom.marked)
    for k in range(1, len(inside)):
        inside[k] |= inside[dom.parent[k]]
    return " ".join(t for owner, t, _ in dom.blocks if inside[owner])


def test_articles_of_the_pages(trained):
    pages, model = trained
    rows = html_text.extract(pages, model, keep=["page_id"]).join(pages, "page_id").collect()
    assert np.mean([r.text == marked(html_text.Dom(r.html)) for r in rows]) > 0.95


def test_layouts_not_seen_in_training(trained):
    pages, model = trained
    shares = []
    for k, row in enumerate(pages.collect()[:60]):
        dom = html_text.Dom(html_text.relayout(html_text.Dom(row.html), 10_000 + k))
        got, want = dom.decode(2 * model.margin(dom.features())).split(), marked(dom).split()
        both = sum(min(got.count(w), want.count(w)) for w in set(want))
        shares.append(2 * both / max(1, len(got) + len(want)))
    assert np.mean(shares) > 0.85


def test_blocks_of_broken_markup():
    dom = html_text.Dom("<p><b>a &amp; b<br>c\n\t d<p>e&nbsp;f<li>g<li>h</div></article><!-- x <p> -->i<script>no</script><textarea>no</textarea> <style>no")
    assert [t for _, t, _ in dom.blocks] == ["a & b c d", "e f", "g", "h", "i"]
    assert html_text.Dom("").blocks == [] and html_text.Dom("plain <3 text").blocks[0][1] == "plain <3 text"
    assert [t for _, t, _ in html_text.Dom("x<div>y").blocks] == ["x", "y"]
    assert html_text.Dom("<div>" * 5000 + "deep").depth[-1] == 5000


def test_decoding_never_contradicts():
    dom = html_text.Dom("<div><p>one</p><p>two</p><aside><p>three</p></aside></div>")
    tags = dom.tag
    logit = np.array([{"#page": -1, "div": 5.0, "aside": -6.0}.get(t, 1.0) for t in tags])
    assert dom.decode(logit) == "one two"
    assert dom.decode(np.full(len(tags), -2.0)) == "" and dom.decode(np.full(len(tags), 2.0)) == "one two three"


def test_flat_trees_are_those_of_the_model():
    stump = (np.array([2, -1, -1]), np.array([0.5, 0, 0]), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, -1.0, 3.0]))
    x = np.zeros((3, 4))
    x[:, 2] = [0.4, 0.5, 0.6]
    assert html_text.Trees([stump, stump], [1.0, 0.5]).margin(x).tolist() == [-1.5, -1.5, 4.5]


def test_edges(spark, trained):
    _, model = trained
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", None, "mine"), (2, None, "", "mine"), (None, "u", "<article><p>" + "word " * 100_000 + "</p></article>", "m"), (3, "u", "<nav>menu</nav>", "m")]
    out = html_text.extract(spark.createDataFrame(rows, schema), model)
    found = {r.page_id: r.text for r in out.collect()}
    assert out.columns == ["page_id", "url", "text"] and found[1] == found[2] == ""
    assert html_text.extract(spark.createDataFrame([], schema), model).count() == 0
    nothing = html_text.train(spark.createDataFrame([], schema))
    assert html_text.extract(spark.createDataFrame(rows, schema), nothing).where(F.length("text") > 0).count() == 0
