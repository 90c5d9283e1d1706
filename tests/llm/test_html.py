"""Cuts against all labelings, and pages against what stands in their articles."""

import html as entities
import itertools
import random
import re

import pytest

from statloom.llm import html as X
from statloom.llm.queries import op8_html_main_text

FOLDER = "/root/testdata/sf0.001"


def test_cut_is_least():
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randint(1, 8)
        costs = [draw.uniform(-3, 3) for _ in range(n)]
        links = {(a, b): draw.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.5}

        def price(label):
            own = sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, label))
            return own + sum(c for (a, b), c in links.items() if label[a] != label[b])

        least = min(price(x) for x in itertools.product([False, True], repeat=n))
        assert price(X.cut(costs, links)) == pytest.approx(least)


PAGES = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    ("just a bare line of text that is long enough to be read as content.", "just a bare line of text that is long enough to be read as content."),
    ("<nav><a href=x>Home</a></nav><article><h1>T&eacute;&amp;</h1><p>One<p>t<b>w</b>o &lt;b&gt;<div class='ad'>Buy now, all of it.</div><p>x.</article>", "Té& One two <b> x."),
    ("<article><p>Long enough a text to keep here.</p><section class='comments'><article><p>First! What a long comment this is.</p></article></section></article>", "Long enough a text to keep here."),
    ("<body class='has-sidebar'><main><header><h1>Head line</h1></header><p>The text of it all.</p></main><aside>Some more words to read.</aside><form><label>Name</label><p>Say who you are.</p></form>", "Head line The text of it all."),
    ("<article><p>a</p><script>var t='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><noscript>no</noscript><p>b</p></article></div></p>", "a b"),
    ("<header>Site</header><div class='cookie-notice'><p>We use cookies for a better view of it.</p></div><article>Text\n of\tthe   page<br>goes&nbsp;on</article><footer>&copy; us</footer>", "Text of the page goes on"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES + PAGES)], "k int, html string")
    found = {r["k"]: r["text"] for r in X.extract(df).collect()}
    assert [found[i] for i in range(len(found))] == [t for _, t in PAGES + PAGES]
    assert X.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.extract(df, text="HTML")


def test_large_pages():
    text = X.main_text("<article>" + "<div>" * 3000 + "<p>deep" + "</div>" * 3000 + "<p>word. " * 20_000 + "</article>")
    assert text == "deep" + " word." * 20_000
    assert X.main_text("<div>" * 2000 + "<p>menu</p>" * 5000)[:4] in ("", "menu")


def test_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = op8_html_main_text(spark, FOLDER).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        body = re.sub(r"</?\w+[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))
        assert r["text"] == " ".join(entities.unescape(body).split()) and r["n_chars"] == len(r["text"])


def test_any_markup_is_read(spark):
    for odd in ("<![ abc", "<p>x</p><![foo[ x", "<![-- x", "<![", "<!", "<!>", "<![endif]-->", "<![CDATA[ x", "<![foo[ a ]]> b", "</", "<a b=", "&#", "&#xffffffff;", "<![if x]>"):
        assert isinstance(X.main_text(odd), str) and "kept here" in X.main_text(f"<p>This is what is kept here, by all means.</p>{odd}")
    draw = random.Random(8)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).collect()]
    pieces = ["<", ">", "<!", "<![", "]]>", "-->", "<!--", "&", "&#", ";", "</", "/>", '"', "'", "=", "<script>", "<![cdata[", "<?", "\x00"]
    for _ in range(3000):
        page = draw.choice(pages)
        at = draw.randrange(max(1, len(page) - 1500))
        page = page[at : at + 1500]
        for _ in range(draw.randint(1, 6)):
            at = draw.randrange(len(page) + 1)
            page = page[:at] + draw.choice(pieces) + page[at + draw.randint(0, 3) :]
        assert isinstance(X.main_text(page), str)
