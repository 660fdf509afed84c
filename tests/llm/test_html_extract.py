import itertools
import random

from examlytics.llm import html_extract as m
from examlytics.llm.html_blocks import read


def test_min_cut_is_least():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        unary = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(keep):
            return (sum(u for u, k in zip(unary, keep) if u > 0 and not k) - sum(u for u, k in zip(unary, keep) if u < 0 and k)
                    + sum(c for a, b, c in edges if keep[a] != keep[b]))

        assert cost(m.min_cut(unary, edges)) == min(cost(k) for k in itertools.product([False, True], repeat=n))


ARTICLE = "<h1>Title &amp; more</h1><p>First <b>paragraph</b>,\n with&nbsp;<a href=x>a link</a>.<br>Next line.<p>Second one &lt;here&gt; says enough words to be prose.</p>"
TEXT = "Title & more\n\nFirst paragraph, with a link. Next line.\n\nSecond one <here> says enough words to be prose."


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them all now.</div>
    <!-- ad <p>no</p> --><div class="ad">Buy this now, it is really very good for you.</div><article>{ARTICLE}</article><aside><p>Related reading that is not part of it.</p></aside>
    <form><label>Mail</label><input><button>Go</button></form><section id="comments"><p>A reader says something long enough to be prose here.</p></section>
    <div hidden><p>Hidden</p></div><footer>&copy; x</footer></body></html>"""
    assert m.extract(page) == TEXT


def test_without_article_element():
    """No article element: text density and the neighbourhood decide."""
    prose = "".join(f"<p>This is a paragraph of running prose, number {i}, that goes on for a good while and ends here.</p>" for i in range(5))
    page = f"<body><div class=menu><a href=a>A</a><a href=b>B</a></div><div id=content>{prose}<p>Short.</p></div><div class=footer>Copyright</div></body>"
    out = m.extract(page).split("\n\n")
    assert len(out) == 6 and out[-1] == "Short."


def test_training(spark):
    """Trained weights leave the data's articles whole, prefer prose without markup, and stay at the prior without labels."""
    import numpy as np
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    w = m.train(pages)
    names = list(m.PRIOR)
    assert w[names.index("linked")] < 0 < w[names.index("in_main")] and w[names.index("log_length")] > 0
    for r in pages.collect():
        page = read(r.html)
        assert m.label(page, w) == [any(n.tag == "article" for n in m._ancestors(b.node)) for b in page.blocks]
    none = spark.createDataFrame([(1, "<p>plain</p>"), (2, None)], "page_id long, html string")
    assert np.array_equal(m.train(none), list(m.PRIOR.values())) and np.array_equal(m.train(none.limit(0)), list(m.PRIOR.values()))
    assert m.extract("<body><div><a href=a>A</a> <a href=b>B</a></div>" + "<p>This is running prose that goes on and ends here.</p>" * 3, w).count("prose") == 3


def test_unclosed_and_broken():
    assert m.extract("<article><p>One two three four five six seven.<p>cut off here &am") == "One two three four five six seven.\n\ncut off here &am"
    assert m.extract("") == "" and m.extract("<nav>x</nav>") == ""
    for bad in ("<", "<p", '<a href="', "<!--", "<script>", "&#x110000;", "</p></div>", "<p/><br/>", "<script", "<title>x"):
        m.extract(bad)


def test_every_cut_of_a_page_is_read():
    page = f"<html><body><nav><a href=a>x</a></nav><article>{ARTICLE}</article><footer>f</footer></body></html>"
    for n in range(len(page)):
        m.extract(page[:n])


def test_deep_and_long():
    assert m.extract("<div>" * 5000 + "<article><p>" + "word " * 50000) == ("word " * 50000).strip()
    page = read("<article>" + "<p>some words here</p>" * 3000)
    assert len(page.blocks) == 3000 and all(m.label(page))


def test_pages(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", 0), (2, None, None, 0), (None, "", "", 1), (1, "u", f"<article>{ARTICLE}</article>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted(map(tuple, m.main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "", "", 0), (1, "u", TEXT, len(TEXT))], key=str)
    assert m.label_pages(pages).filter("content").count() == 6
    assert m.main_text(pages.limit(0)).count() == 0


def test_names_of_wrappers_and_articles_lose_nothing():
    rest = "<div class=sidebar><p>Something else that is said beside the article, at length.</p></div>"
    for open_, close in [
            ("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class='site no-ads'><article>", "</article></div>"),
            ("<article class='post category-legal'>", "</article>"), ("<article class='post tag-social'>", "</article>"),
            ("<div class='content-sidebar-wrap'><main>", "</main></div>"), ("<div class=sidebar-right><article>", "</article></div>"),
            ("<main><div class=page-with-sidebar><article class='news legal'>", "</article></div></main>"),
            ("<article><div class='entry-header'><p>Over the title</p></div>", "</article>")]:
        over = "Over the title\n\n" if "Over" in open_ else ""
        assert m.extract(f"<body>{rest}{open_}{ARTICLE}{close}{rest}</body>") == over + TEXT, open_
    for name in ("comments", "post-comments", "cookie-notice", "widget2", "share-buttons", "related_posts", "site-footer"):
        assert m.extract(f"<main>{ARTICLE}<div class='x {name}'><p>Not of the article, though it is long enough.</p></div></main>") == TEXT, name
    prose = "".join(f"<p>This is a paragraph of running prose, number {i}, that goes on for a good while and ends here.</p>" for i in range(5))
    assert m.extract(f"<body><div class='layout has-sidebar'>{prose}</div></body>").count("prose") == 5


def test_captions_formulas_and_open_heads():
    caption = "<figure><img src=x><figcaption>What the picture shows, in a sentence.</figcaption></figure>"
    formula = "<p>The area is <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>a=2</annotation></semantics></math> here.</p>"
    assert m.extract(f"<article>{ARTICLE}{caption}{formula}</article>") == f"{TEXT}\n\nWhat the picture shows, in a sentence.\n\nThe area is a=2 here."
    for head in ("<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><script>x</script>", "<head>"):
        assert m.extract(f"<html>{head}<article>{ARTICLE}</article></html>") == TEXT
        assert m.extract(f"<html>{head}<body><article>{ARTICLE}</article></html>") == TEXT
