"""Extraction: held-out accuracy, the given pages, parsing and decoding."""

import itertools
import math
import re

import numpy as np
import pytest

from emberlog.llm import html_extract as he
from emberlog.llm.pages_for_training import pages


@pytest.fixture(scope="module")
def model(spark):
    return he.fitted(spark)


def test_held_out_accuracy(model):
    batch = [he.parsed(h) for h in pages(120, he.SEED + 1)]
    x, parent, depth = he.features(batch)
    kept = he.decode(model.keep_probability(x), parent, depth)
    y = np.concatenate([p.label for p in batch])
    assert (kept[y >= 0] == (y[y >= 0] == 1)).mean() > 0.97


def test_given_pages(spark, model):
    """The synthetic pages hold their main text in one article element."""
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = he.query(spark, sf).collect()
    assert len(rows) == len(html)
    same = 0
    for r in rows:
        inner = re.search(r"(?s)<article.*?>(.*)</article>", html[r.page_id])
        page = he.parsed(inner[1] if inner else "")
        same += r.text == he.page_text(page, np.ones(len(page.tag), bool))
        assert r.n_chars == len(r.text)
    assert same / len(rows) > 0.97


def test_decoding_is_the_best_choice_without_contradiction():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n = int(rnd.integers(2, 9))
        parent = np.array([-1, *(int(rnd.integers(0, i)) for i in range(1, n))])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        p = rnd.uniform(0.05, 0.95, n)
        p[0] = 0.999999

        def score(k, p=p):
            return sum(math.log(q if x else 1 - q) for q, x in zip(p, k, strict=True))

        allowed = [k for k in itertools.product((False, True), repeat=n) if k[0] and all(not k[i] or k[parent[i]] for i in range(1, n))]
        got = he.decode(p, parent, depth)
        assert score(got) == pytest.approx(max(map(score, allowed)))


def test_blocks_references_and_left_open_elements(model):
    page = he.parsed("<p>a &amp;  b&nbsp;c<b>d\n e<p>f<br>g<ul><li>x<li>y</ul><script>no</script>&#233;")
    assert he.page_text(page, np.ones(len(page.tag), bool)) == "a & b cd e\nf g\nx\ny\né"


def test_elements_left_open_do_not_swallow_the_page():
    def text(html):
        page = he.parsed(html)
        return he.page_text(page, np.ones(len(page.tag), bool))

    assert text("<article><p>Before<select><option>a<option>b</article><p>After").startswith("Before")
    assert text("<article><p>Before<select><option>a<option>b</article><p>After").endswith("After")
    assert text("<article><p>Before<select><option>a</article><p>After</p><select><option>b</select>End") == "Before\nAfter\nEnd"
    assert text("<p>Before<svg><path><p>After") == "Before\nAfter"
    assert text("<div>Before<object><param></div><p>After<object>x</object>y") == "Before\nAftery"
    assert text("<p>a<svg><title>t</title><text>n</text></svg>b<iframe>x</iframe>c<template><p>no</div></template>d") == "abcd"
    assert text("<p>a<noscript>no") == "ano"
    deep = text("<div>" * 3000 + "x" + "<svg>" * 5000 + "<p>y")
    assert deep == "x\ny"


def test_markup_left_open_is_no_text():
    """What a browser shows, by hand: everything that the parser has run into."""

    def shown(html):
        return "".join(t for _, t in he.parsed(html).run if t)

    cases = {
        "<p>a</p><!-- unclosed <p>b</p> more": "a",
        "<p>a</p><!-- closed --><p>b</p>": "ab",
        "<p>a</p><!bogus <p>b</p>": "ab",  # up to the first >
        "<p>a</p><!bogus": "a",
        "<p>a</p><?php echo 1": "a",
        "<p>a</p><?xml x?><p>b</p>": "ab",
        "<p>a</p><div class='x": "a",
        "<p>a</p></div": "a",
        "<p>a < b and c<d</p>": "a < b and c",
        "<div><select><option>x<option>y</div><p>b</p>": "b",
        "<div><p>a<select><option>x</select>c</p></div>": "ac",
        "<form><select><option>x<input>rest</form>b": "restb",
        "<select><option>x<p>y": "",
        "<p>a</p><!doctype html><p>b": "ab",
        "<p>1 <!-- x --!> 2</p>": "1  2",
    }
    assert {h: shown(h) for h in cases} == cases
    assert shown("<p>a" + " <!-- x -->" * 30_000 + "<!-- " + "<p>y</p>" * 30_000).strip() == "a"


def test_large_pages_are_judged_alone_and_alike(model, monkeypatch):
    batch = pages(12, 5)
    whole = he.texts_of(batch, model)
    monkeypatch.setattr(he, "NODES_AT_ONCE", 30)
    assert he.texts_of(batch, model) == whole


def test_null_empty_broken_and_repeated_pages(spark, model, as_table):
    deep = "<div>" * 600 + "deep text of an article that goes on, and on." + "</div>" * 600
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p><b"), (4, "u", deep), (4, "u", deep), (None, "u", "<<<>>>&#xfffff;")], "page_id bigint, url string, html string")
    rows = he.query(spark, as_table("pages", df)).collect()
    assert len(rows) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (1, 2)} == {""}
    assert len({r.text for r in rows if r.page_id == 4}) == 1
    assert he.query(spark, as_table("pages", df.where("false"))).count() == 0


def test_query_with_clashing_names(spark, as_table):
    page = "<article><p>Some words of an article that is long enough to be one, and then it goes on.</p></article>"
    df = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    plain = he.query(spark, as_table("pages", df)).collect()
    wide = he.query(spark, as_table("pages", df.selectExpr("*", "7 AS text", "'x' AS n_chars", "8 AS main"))).collect()
    assert plain == wide and len(wide) == 1
