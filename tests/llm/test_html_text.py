import html
import random
import time

import pytest

from tidemark.llm import html_text
from tidemark.llm.queries import QUERIES

PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; simple text", "plain & simple text"),
    ('<html><head><title>T</title><script>var t="</p>";x(0)</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Big  &lt;One&gt;</h1><p><b>Bold<br><p>Be.</p><p>Er&nbsp;in.</p></article><footer>&copy; x</footer></body></html>', "Big <One> Bold Be. Er in."),
    ("<body><header><h1>Site</h1></header><main><p>One two.</p><aside>Side</aside><form>Sign <input> up</form><div class='comments'><p>I like it</p></div><p>Three.</main><div id=cookie-notice>We use cookies</div>", "One two. Three."),
    ("<div class='sidebar'><p>Links here</p></div><div><p>Some longer paragraph of text that has no article around it at all.</p><p>Short.</p></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul>", "Some longer paragraph of text that has no article around it at all. Short."),
    ("<article>a <!-- b --> c<script>d</script><style>e</style> <a href=q>f</a>g<span hidden>no</span></article>", "a c fg"),
    ("<article><p>1 &lt; 2 &#233; &eacute;</p><pre>x\n\n  y</pre><table><tr><td>c1<td>c2</table></article>", "1 < 2 é é x y c1 c2"),
    ("<article><header><h1>Title</h1></header><p>Text</p><div class='ad'>Buy</div><div class=advert-box>Now</div></article>", "Title Text"),
    ("<article><p>Text</p><div class=sidebar><h3>Related</h3><p>More of it</p></div><section class='comments'><h2>2 comments</h2><p>Nice</p></section><p>End</p></article>", "Text End"),
    ("<div id=top>Welcome stranger, read on below</div><div class='post-content'><p>The post.</p><div class=post-footer>Filed under x</div></div><p>Some other line that stands outside of it all.</p>", "The post."),
    ("<article><p title=it's>Hello there</p><p>It's fine and more</p></article>", "Hello there It's fine and more"),
    ("<article><p>Intro.</p><div class=share-price><p>Up by ten</p></div><div class='social-history'><p>A past of its own</p></div></article>", "Intro. Up by ten A past of its own"),
    ("<html><head><title>T</title><meta charset=x><p>The head was never closed, yet this is text.</p>", "The head was never closed, yet this is text."),
    ("<article><p data-x='never closed>One two</p><p>three</p></article>", "One two three"),
    ("<article><p>See <a href=x>the whole long linked sentence here</a></p><p>and this.</p></article>", "See the whole long linked sentence here and this."),
    ("<form id=page><nav><a href=1>Home</a></nav><article><p>Text in a form that spans the page.</p><form>Search <input></form></article></form>", "Text in a form that spans the page."),
    ("<article><p>a</p><![CDATA[ b ]]><p>c</p><!-->d<!---><p>e</p><!bogus><?php x ?></article>", "a c d e"),
    ("<article><h1>T</h1><p>First words of the text.</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul></article>", "T First words of the text."),
    ("<div class=post-footer>x</div><div class=site-header>y</div><article class='post content'><p>Text</p><div class='comments-area'>Nice one</div></article><div id=cookie_banner>We use cookies</div>", "Text"),
    ("<article><p>Text</p><div class=shareButtons><a href=1>Post it</a></div><div id=sideBar><p>Some more</p></div><div class='new-comments-count'>3</div><div class=adoption-story><p>Kept</p></div></article>", "Text Kept"),
    ("<p>unclosed <b>bold <i>both", "unclosed bold both"), ("a < b and c > d", "a < b and c > d"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_query_on_generated_pages(spark, tmp_path):
    rnd = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(rnd.choice(["word", "a&b", "<x>", "é", "long-word,"]) for _ in range(rnd.choice([1, 2, 30, 200]))) for _ in range(rnd.randrange(1, 9))]
        body = "".join(f"<p>{html.escape(p)}</p>\n" for p in paragraphs)
        rows.append((i, None if i == 3 else f"http://x/{i}", f"<html><body><nav><a href=/>Home</a></nav><div class='ad'>buy this now</div><article>{body}</article><footer>&copy; all rights</footer></body></html>", "clash"))
        want[i] = " ".join(paragraphs)
    rows += [(None, "u", None, "clash"), (99, "u", "<article>" + "<p>deep" * 30_000, "clash")]
    want |= {None: "", 99: " ".join(["deep"] * 30_000)}
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op7_html_main_text"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_tree_fits_its_table():
    rows, labels = html_text.labelled_table()
    assert (html_text.trained_tree().predict(rows) == labels).mean() > 0.99


def test_formulas_and_fallback_text_of_objects_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object data=a.pdf><p>Read the report here.</p></object></article>"
    assert html_text.main_text(page) == "Let x=2 hold. Read the report here."


def test_no_depth_is_too_deep():
    page = "<article>" + "<div>" * 2600 + "<aside>" + "<div>" * 4000 + "LEAK" + "</div>" * 4000 + "</aside>" + "</div>" * 2600 + "<p>Keep</p></article>"
    assert html_text.main_text(page) == "Keep"


BROKEN = ["<a b ", "<a b='", '<a b="', "<p x=y ", "</ ", "<i>", "<div><b>", "</div>", "<div></span>", "<b><div></i>", "<!--", "<!", "&", "<table><td>", "<a =", "<script>", "<p>x"]


@pytest.mark.parametrize("part", BROKEN)
def test_a_megabyte_of_broken_markup_takes_little_time(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.main_text(page)
    whole = time.process_time() - began
    assert whole < 6
    began = time.process_time()
    html_text.main_text(page[: len(page) // 4])
    assert whole < 12 * (time.process_time() - began) + 0.5  # in proportion, not its square


def test_generated_pages_without_names(spark):
    """Pages of bare boxes, with and without an article element, against what went into them."""
    rnd, wrong, total = random.Random(4), 0, 0
    words = lambda a, b: " ".join(rnd.choice(["sea", "über", "stone,", "of", "Ein", "winter.", "a&b"]) for _ in range(rnd.randint(a, b)))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{k}'>{html.escape(words(1, 2))}</a>" for k in range(n)) + "</ul>"
    for i in range(200):
        marked = i % 2 == 0
        want = [words(12, 90) for _ in range(rnd.randint(2, 7))]
        if marked:
            want.insert(1, words(1, 4))
        inner = "".join(f"<p>{html.escape(p)}</p>" if k % 3 or not marked else f"<div><p>{html.escape(p[:5])}<i>{html.escape(p[5:])}</i></div>" for k, p in enumerate(want))
        body = f"<article>{inner}</article>" if marked else f"<div><div>{inner}</div></div>"
        outside = f"<div><p>{html.escape(words(4, 40))}</p></div>" if marked else links(rnd.randint(4, 9))
        page = f"<body><div>{links(rnd.randint(3, 8))}</div>{body}<div>{links(rnd.randint(4, 9))}</div>{outside}"
        wrong += html_text.main_text(page) != " ".join(want)
        total += 1
    assert wrong <= 0.02 * total
