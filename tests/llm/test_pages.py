import html
import re

import pytest

from tesserine.llm import pages, queries
from tests.llm.conftest import SF


def text(source, mains=(), fixed=()):
    return pages.main_text(source, list(mains), set(fixed), None)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain <b>bold</b> &amp; text", "plain bold & text"),
        ("a < b and <i>c</i>d", "a < b and cd"),
        ("<p>one\n  two&nbsp;three<p>four<br>five</p>", "one two three\nfour five"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>A<script>x<y</script>B<!-- no --></p><aside>side</aside><div class='comments'>c</div></article><footer>f</footer>", "T\nAB"),
        ("<header>top</header><main><header><h1>Title</h1></header><p>Body text here</p><form>no</form></main>", "Title\nBody text here"),
        ("<div class='sidebar'>s s s s</div><div id='content'><p>Long main text of the page is here.</p><div class='cookie-notice'>accept</div></div><div class='ad'>buy</div>", "Long main text of the page is here."),
        ("<div class='site-header'>Name of the site</div><article><div class=header><h1>T</h1></div><section id='comments'>no</section><p>x</p><div hidden>no</div></article>", "T\nx"),
        ("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>", "a\nb\nc\nd\ne"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
        ("<article><p>x</article><article class='comment'><p>reader reader reader</article>", "x"),
        ("<p title='a>b'>q</p><p x=\"un", "q"),
        ("<title>no</title><textarea>no</textarea><p>&lt;p&gt; &#65;&#x42;&notanentity;</p>", "<p> AB¬anentity;"),
    ],
)
def test_main_text(source, want):
    assert text(source) == want


def test_deep_and_broken_pages_end():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("</p>" * 1000 + "<a href='" + "y" * 1000) == ""
    assert text("<!-- never closed <p>x") == ""


def test_query_over_the_table(spark):
    found = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_html_extraction(spark, SF).collect()
    assert len(rows) == len(found)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", found[r["page_id"]])[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_template_finds_the_slot_where_no_element_says_so(spark):
    body = "<div class=a><div>Home News Contact About us Terms Privacy Jobs Press Help Sitemap Login</div></div><div class=b><div class=x><p>{}</p></div><div>All rights belong to somebody</div></div>"
    rows = [(i, f"http://h.example/{i}", body.format(f"Own text number {i}, " + "which is long. " * (12 + i)), 1) for i in range(6)]
    out = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert all(out[i].startswith(f"Own text number {i}") and "\n" not in out[i] for i in range(6))


@pytest.mark.parametrize("name", ["legal-analysis", "notice-board", "share-price", "form-of-the-poem", "comment-on-the-text", "adverse events", "search-for-meaning", "hidden-figures"])
def test_names_that_only_sound_like_side_matters(name):
    assert text(f"<article><h1>T</h1><section class='{name}'><p>Main text.</p></section><div id='{name}'>More.</div></article>") == "T\nMain text.\nMore."


def site(kind, n=24):
    """Pages of one host with boilerplate that only its recurrence tells, and the texts that are right."""
    rows, want = [], {}
    for i in range(n):
        own = [f"Paragraph {k} of story {i} tells {'a long tale ' * (3 + (i * 7 + k) % 5)}{i * k}." for k in range(4)]
        body = f"<h1>Story {i}</h1>" + "".join(f"<p>{x}</p>" for x in own)
        extra = "<p>Join our club today and read on for free.</p><div class='share'>Tell your friends</div>"
        if kind == "article":
            html = f"<nav>Home</nav><article>{body}{extra}</article><div>Reader {i} said: what a tale number {i}</div>"
        else:
            html = f"<div class=top><div>Home News Contact About</div></div><div class=story>{body}{extra}</div><div class=end><p>All rights belong to somebody</p></div>"
        rows.append((i, f"http://h.example/{kind}/{i}", html))
        want[i] = "\n".join([f"Story {i}", *own])
    return rows, want


def found(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("kind", ["article", "none"])
def test_the_template_decides(spark, kind):
    rows, want = site(kind)
    assert found(spark, rows) == want
    alone = {i: text(html) for i, _, html in rows}
    assert all("Join our club" in x for x in alone.values())  # without the template it would stay


def test_layouts_of_a_few_pages_have_templates_too(spark):
    big, want_big = site("article", 60)
    small = [(1000 + i, "http://h.example/s", f"<div class=other><section><h2>Part {i}</h2><p>{'Something else entirely. ' * (5 + i)}</p><p>Read our terms of use.</p></section></div>") for i in range(4)]
    out = found(spark, big + small)
    assert {i: out[i] for i in want_big} == want_big
    assert all("terms of use" not in out[1000 + i] and f"Part {i}" in out[1000 + i] for i in range(4))


def test_near_copies_keep_their_article(spark):
    story = [f"Paragraph {k} of the one story {'goes on and on ' * (k + 3)}" for k in range(8)]
    rows = [(i, "http://h.example/x", "<nav>m</nav><article>" + "".join(f"<p>{x} {i if k == i % 8 else ''}</p>" for k, x in enumerate(story)) + "</article>") for i in range(30)]
    out = found(spark, rows)
    assert all(len(out[i].split("\n")) == 8 for i in range(30))


def test_copies_keep_their_article(spark):
    page = "<nav>m</nav><article><p>The same text on every page.</p></article>"
    rows = [(i, "http://h.example/x", page) for i in range(5)] + [(5, "http://h.example/x", page)]
    assert {r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same text on every page."}


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (2, "nonsense", "<p>b"), (3, "http://x.y/z", None), (None, "http://x.y/z", ""), (4, "http://x.y", "<p>" + "w " * 300_000), (4, "http://x.y", "<p>c")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, key string, host long")
    out = pages.extract(df)
    assert sorted(r["n_chars"] for r in out.collect()) == [0, 0, 1, 1, 1, 599_999]
    assert pages.extract(df.limit(0)).collect() == [] and out.columns == ["page_id", "url", "text", "n_chars"]
