"""HTML extraction: given pages whole, unseen layouts, exact inference, broken markup."""

import html as html_lib
import itertools
import math
import random
import re

import pytest

from tidemark.llm import html_text as ht


@pytest.fixture(scope="module")
def model(spark):
    return ht.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "url", "html")


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [re.sub(r"<[^>]+>", " ", b) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in (" ".join(html_lib.unescape(b).split()) for b in blocks) if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = ht.extract(pages).join(pages.drop("url"), "page_id").collect()
    assert len(rows) == 250
    assert all(r["text"] == article(r["html"]) and r["n_chars"] == len(r["text"]) for r in rows)


PROSE = ["Thion er the andest of erly, on that.", "Short one.", "The ander enst of the thion, erly and that er was the onshe in it to of there. " * 3]
OTHERS = [
    '<div class="cookie-notice"><p>We use the ander enst of cookies, erly and that.</p><button>Ok</button></div>',
    '<aside class="sidebar"><h3>More</h3><ul><li><a href="/x">The ander</a></li><li><a href="/y">Of it</a></li></ul></aside>',
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I like the ander enst of the thion, erly and that.</p></div></section>',
    '<form action="/s"><label>Name</label><input name="n"><p>Send the ander enst.</p></form>',
    '<div class="ad">The ander enst of the thion, erly and that er was the onshe.</div>',
    '<header><p>The onshe</p></header><nav><a href="/">Home</a> <a href="/a">About</a></nav>',
]


@pytest.mark.parametrize("frame", [
    "<article><h1>{0}</h1><p>{1}</p><p>{2}</p></article>",
    '<main><div class="content"><h1>{0}</h1><p>{1}</p><p>{2}</p></div></main>',
    '<div class="post"><h1>{0}</h1><p>{1}<p>{2}</div>',
])
@pytest.mark.parametrize("before,after", [(0, 2), (5, 3), (4, 1), (5, 2)])
def test_sections_around_the_article_are_left_out(model, frame, before, after):
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{OTHERS[before]}{frame.format(*PROSE)}{OTHERS[after]}<footer>&copy; Site</footer></body></html>"
    assert ht.main_text(page, model) == "\n\n".join(" ".join(t.split()) for t in PROSE)


def test_messages_equal_summing_over_all_labellings(model):
    page = '<div class="post"><p>The ander enst of it.</p><ul class="menu"><li><a>x</a></li></ul></div>'
    nodes = ht.parse(page)
    weight = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        log = model.root[labels[0]]
        for i in range(1, len(nodes)):
            log += model.links[ht.kind_of(nodes, nodes[i])][labels[nodes[i].parent]][labels[i]]
            log += labels[i] * sum(model.own.get(f, 0.0) for f in ht.features(nodes, i))
        total += math.exp(log)
        for i, y in enumerate(labels):
            weight[i] += y * math.exp(log)
    assert ht.marginals(nodes, model) == pytest.approx([w / total for w in weight])


def test_references_white_space_and_broken_markup(model):
    page = ('<article><h1>A &lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;x</h1><!-- <p>no</p> --><p>One\n\n  two<br>three <b>fo</b>ur.'
            '<script>if (a < b) { "</p>" }</script> 1 < 2 and <i title="a>b">five.</i><p>Last words of it &am')
    assert ht.main_text(page, model) == "A <b> &amp; éé x\n\nOne two three four. 1 < 2 and five.\n\nLast words of it &am"
    for broken in ["<", "<p", "</", "<!--", "<script>", '<p class="', "</p></div>", "<>", "<table><tr><td>x", "a" * 100_000, "<div>" * 3000]:
        assert isinstance(ht.main_text(broken, model), str)


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", "<article><p>The ander enst of it, erly.</p></article>", 3)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, ht.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", got[2][2], len(got[2][2]))] * 2, key=str)
    assert ht.extract(df.where("false")).collect() == []


@pytest.mark.parametrize("page,text", [
    ("<article><p>The ander enst of it, erly.</p></article>", "The ander enst of it, erly."),
    ("<article><h1>The onshe</h1><p>{}</p><p>Short one.</p></article>".format(PROSE[2].strip()), f"The onshe\n\n{PROSE[2].strip()}\n\nShort one."),
    ("<html><body><div><h1>A title</h1><p>The ander enst of it, erly.</p><p>So it was.</p></div></body></html>", "A title\n\nThe ander enst of it, erly.\n\nSo it was."),
])
def test_tables_of_plain_articles_keep_their_text(spark, page, text):
    df = spark.createDataFrame([(i, "u", page) for i in range(3)], "page_id long, url string, html string")
    assert [tuple(r) for r in ht.extract(df).collect()] == [(i, "u", text, len(text)) for i in range(3)]


KEPT = "The ander enst of it, erly. Hat thon was reing by the ouer, and so it ended."


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><meta><article><p>{}</p></article>",
    "<html><head><title>t <b>x</title><script>'<p>no</p>'</script><style>p > a {{}}</style><p>{}</p>",
    "<head><link><template><p>no</p></template></head><article><p>{}</p></article>",
    "<article><div><button>Go</div><p>{}</p></article>",
    "<article><div><select><option>a<option>b</div><p>{}</p></article>",
    "<article><div><svg><path></div><p>{}</p></article>",
    "<article><button><div>Go</div></button><p>{}</p></article>",
    "<article data-label=\"1\"><p data-label='Price' data-label=x data-label=>{}</p></article>",
])
def test_no_article_is_lost(model, page):
    assert ht.main_text(page.format(KEPT), model) == KEPT


def test_any_tags_and_attributes(model):
    rng = random.Random(3)
    bits = ["<", ">", "</", "/>", "'", '"', "=", " ", "data-label", "class", "id=9", "&amp;", "&#x;", "text", "<!--", "-->", "\n"]
    bits += [f"<{t}" for t in [*ht.SKIPPED, *ht.BLOCKS]] + [f"</{t}>" for t in [*ht.SKIPPED, *ht.BLOCKS]]
    for _ in range(400):
        assert isinstance(ht.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 60))), model), str)
