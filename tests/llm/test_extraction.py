import random

from pagewright.llm.extraction import extract_pages, labelled_blocks, main_text, trained_tree

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a><p>Tagline of the site</p></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- ad 0 --><div class="ad">Buy now and save a lot of money today with us.</div><div id="cookie-notice">We use cookies to make this site better for you. <button>OK</button></div>
<article><header><h1>Head &amp; title</h1></header><p><b>First   para&shy;graph&nbsp;with
 words.<br>more<p>Un<i>closed</i> one</p><p>Ok.</p><div class="ad-box">Advert inside the article</div><p>Last &lt;b&gt; &#233;.</p>
<section class="comments"><h2>Comments</h2><article class="comment"><p>I liked this article very much indeed, thank you for writing it.</p></article></section></article>
<aside><h3>Related</h3><p>Some other long text in the side bar that goes on and on and on.</p></aside>
<form><label>Mail</label><input name=q><p>Enter your mail address here to get our letter.</p></form>
<footer>&copy; 2020 Site &middot; words</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "Head & title First para\xadgraph with words. more Unclosed one Ok. Last <b> é."


def test_edges():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<nav>a b c</nav>") == ""
    long = "word " * 40
    assert main_text(f"<p>{long}</p>") == long.strip()
    assert main_text(f"<nav><a href=x>a</a><article><p>Text here.</p></article>") == "Text here."
    assert main_text(f"<div class=content><p>{long}<footer>x</footer>").strip() == long.strip()
    assert main_text("<article><p>a &am") == "a &am"
    assert main_text("<article><p>1 < 2 and 3 > 2</p><script>if (a < b) '<p>no</p>'") == "1 < 2 and 3 > 2"
    assert main_text("<article>" + "<p>one</p>" * 5000 + "</article>").count("one") == 5000
    assert main_text("<article><p>t</p></article><footer><p>Foot text") == "t"


def test_tree_fits_its_pages():
    rows, labels = labelled_blocks()
    wrong = 0
    for x, y in zip(rows, labels, strict=True):
        node = trained_tree()
        while not isinstance(node, int):
            node = node[3] if x[node[0]] > node[1] else node[2]
        wrong += node != y
    assert len(rows) > 150 and wrong <= 3


def test_names_that_only_look_like_furniture():
    words = lambda n: " ".join(["word"] * n)
    for name in ("related-work", "comments-on-the-text", "navigation-of-ships", "further"):
        assert main_text(f"<article><h1>Head</h1><p>{words(30)}</p><section id='{name}'><h2>Part</h2><p>{words(60)}</p><p>{words(50)}</p></section></article>").count("word") == 140, name
    for name in ("comments", "site-nav", "share-buttons", "cookie-consent", "ad top"):
        assert main_text(f"<article><p>{words(30)}</p><div class='{name}'><p>{words(40)}</p></div></article>").count("word") == 30, name


def plain_pages(rng):
    """Pages with what is text of them, built side by side."""
    for _ in range(120):
        text, page = [], []
        sentence = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "d&eacute;lta"]) for _ in range(n))
        block = lambda: sentence(rng.randint(9, 80))
        if rng.random() < 0.8:
            page.append("<nav><ul>" + "".join(f"<li><a href=x>{sentence(2)}</a></li>" for _ in range(rng.randint(1, 7))) + "</ul></nav>")
        if rng.random() < 0.5:
            page.append(f"<div class='{rng.choice(['ad', 'advert', 'cookie-banner', 'promo box'])}'>{block()}</div>")
        body = []
        for _ in range(rng.randint(2, 9)):
            x = block()
            kind = rng.random()
            if kind < 0.7:
                body.append(f"<p>{x}</p>")
                text.append(x)
            elif kind < 0.8:
                body.append(f"<div class=advert><p>{x}</p></div>")
            elif kind < 0.9:
                body.append(f"<script>{x}</script><form><p>{x}</p></form>")
            else:
                body.append(f"<p>{x}<br>{x}</p>")
                text.append(f"{x} {x}")
        page.append(f"<article>{''.join(body)}</article>")
        if rng.random() < 0.5:
            page.append(f"<section class=comments><p>{block()}</p><p>{block()}</p></section>")
        page.append(f"<aside><p>{block()}</p></aside><footer>{sentence(8)}</footer>")
        yield "<html><body>" + "".join(page) + "</body></html>", " ".join(text).replace("&eacute;", "é")


def test_generated_pages():
    wrong = [page for page, text in plain_pages(random.Random(1)) if main_text(page) != text]
    assert len(wrong) <= 2, wrong[:1]


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = extract_pages(pages).collect()
    assert [r.page_id for r in rows].count(1) == 2 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id == 2] == [""]
    assert extract_pages(pages.limit(0)).count() == 0


def test_self_closed_and_inline_elements():
    for icon in ("<svg class='i'/>", '<svg/>', '<svg viewBox="0 0 > 1" data-u="/a/"/>', "<SVG a=/x/y />", "<math/>", '<math class="i"/>', "<svg><path d='M0'/><text>no</text></svg>", "<svg a=1></svg>"):
        assert main_text(f"<article><p>Before {icon} after.</p><p>More text.</p></article>") == "Before after. More text.", icon
    assert main_text("<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>") == "Where x=2 holds."
    assert main_text("<article><p>See <object data=a.pdf><b>the paper</b></object> here.</p></article>") == "See the paper here."
    assert main_text("<article><p>t</p><script src='x'/>no</p></script><p>u</p></article>") == "t u"
