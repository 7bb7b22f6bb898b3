"""Main text of pages: planted layouts, density figures by recursion, odd pages, and the given pages."""

import math
import re
from html import unescape

import pytest

from tarnlake.llm import html_text
from tarnlake.llm.html_text import Page, main_text

ARTICLE = "<h1>Head &amp; line</h1><p>First  paragraph,\n with <b>bold</b> and <a href=x>linked</a> words.<br>Next line.</p><ul><li>one<li>two</ul><p>Short."
TEXT = "Head & line First paragraph, with bold and linked words. Next line. one two Short."
MENU = "<ul>" + "".join(f"<li><a href='/{k}'>Menu entry {k}</a></li>" for k in range(12)) + "</ul>"
LONG = "<p>" + "a reader says much more than the author ever did, " * 30 + "</p>"


@pytest.mark.parametrize("left", [
    "<nav>" + MENU + "</nav>", "<header><h1>Site</h1></header>", "<div class='Cookie-notice'>We use cookies.</div>", "<aside>side</aside>",
    "<div id=sidebar>" + LONG + "</div>", "<form><label>Name</label><input name=q value=v><button>Go</button></form>", "<script>if (a<b) x('</p>')</script>",
    "<style>p{margin:0}</style>", "<div role=navigation>" + MENU + "</div>", "<div class=ad>Buy this.</div>", "<!-- a <p> comment -->", "<section class=comments>" + LONG * 3 + "</section>",
    "<div id=comments><article class=comment>" + LONG * 3 + "</article><article>" + LONG * 4 + "</article></div>", "<footer>&copy; 2020 " + LONG + "</footer>",
    "<div style='display: none'>hidden</div>", "<p hidden>hidden</p>", "<noscript><p>on</p></noscript>", "<template><p>t</p></template>", "<textarea>a</textarea>", "<select><option>a<option>b</select>",
    "<dialog open>Hi</dialog>", "<svg><text>s</text></svg>", "<div class='related'><article>Other story</article></div>",
])
@pytest.mark.parametrize("where", ["before", "after", "inside"])
def test_parts_that_are_no_article(left, where):
    if where == "inside" and left.startswith("<header"):
        return  # an article's own header stays
    inner = ARTICLE + "</p>" + left if where == "inside" else ARTICLE
    body = (left if where == "before" else "") + f"<article>{inner}</article>" + (left if where == "after" else "")
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>{body}</body></html>") == TEXT


def test_own_header_of_an_article():
    assert main_text("<header>Site</header><main><article><header><h1>Own</h1></header><p>Text.</article></main>") == "Own Text."


def test_misleading_names_never_empty_a_page():
    assert main_text("<body><div class='sidebar'><p>All there is on this page.</div>") == "All there is on this page."
    assert main_text("<div class='with-sidebar no-comments'><article><p>Text.</article></div>") == "Text."


def test_pages_without_marks():
    """Density alone tells the text from a menu and a list of links."""
    story = "".join(f"<p>Paragraph {k} has a good number of words in it, more than any entry of a menu.</p>" for k in range(6))
    page = f"<body><div>{MENU}</div><div><h2>Title</h2><div>{story}</div></div><div>{MENU}</div></body>"
    assert main_text(page) == "Title " + " ".join(re.findall("<p>(.*?)</p>", story))


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), (" \n", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>", ""), ("<body></body>", ""), ("a < b and c > d", "a < b and c > d"),
    ("<article>a<b>b</b>c<br>d&nbsp;&#101;&#x66;&bogus; &amp;amp;</article>", "abc d ef&bogus; &amp;"), ("<article>cut off <p>in a ta<", "cut off in a ta<"), ("<article>cut off <p>in a <b cl", "cut off in a"),
    ("<article><table><tr><td>1<td>2<tr><th>3</table>", "1 2 3"), ("<article><p>a</b></i></p></p>b</article>", "a b"), ("<article>x<!-->y<!--- z -->w<!-- open", "xyw"), ("<article>x<a title='a>b'>y</a></article>", "xy"),
    ("<ARTICLE>Up<SCRIPT>no</SCRIPT></ARTICLE>", "Up"), ("<article>\x00a b c\U0001f600</article>", "\x00a b c\U0001f600"), ("<article><p><b>One<br><p>two</article>", "One two"),
    ("<article><dl><dt>t<dd>d<dt>u</dl></article>", "t d u"), ("<article>x</article", "x"), ("x", "x"), ("<article><a>Only a link</a></article>", "Only a link"), ("<div><a>Only a link</a></div>", "Only a link"),
])
def test_odd_pages(source, text):
    assert main_text(source) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</b></i>" * 20_000) == "deep"
    assert main_text("<b>" * 3000 + "<article>x" + "<p>" * 30_000) == "x"
    words = "word " * 400_000
    assert main_text(f"<article><p>{words}</article>") == words.strip()


def nested(page: Page, node=0):
    below = [k for k in range(len(page.names)) if page.parents[k] == node]
    return node, [nested(page, k) for k in below]


def test_figures_by_recursion():
    page = Page("<body><div>ab <a>cde</a><p>f<b>g</b> h</p><p><a>ij</a> klm</p></div><p>no<br>pq</p></body>")
    gone = [False] * len(page.names)
    gone[-2] = gone[-1] = True  # the last paragraph with its break
    density, sums, _ = html_text.densities(page, gone)
    own = {}
    for node, text in page.texts:
        own[node] = own.get(node, 0) + len(text.replace(" ", ""))
    inline = html_text.INLINE

    def figures(tree, in_link=False):
        """Characters, tags, link characters, link tags below; density and sum, checked on the way up."""
        node, children = tree
        link = in_link or page.names[node] == "a"
        total = [own.get(node, 0), 0, own.get(node, 0) * link, 0]
        loose, parts = list(total), []
        for child in children:
            if gone[child[0]]:
                continue
            counts, spare, value = figures(child, link)
            is_link = page.names[child[0]] == "a"
            total = [a + b for a, b in zip(total, [counts[0], counts[1] + 1, counts[2], counts[3] + is_link], strict=True)]
            if page.names[child[0]] in inline:
                loose = [a + b for a, b in zip(loose, [spare[0], spare[1] + 1, spare[2], spare[3] + is_link], strict=True)]
            else:
                parts.append(value)

        def composite(c, t, lc, lt):
            if not c:
                return 0.0
            t = max(t, 1)
            base = max(math.e, math.log(c / max(1, c - lc) * lc + share * c + math.e))
            return c / t * math.log(max(c / max(1, lc) * t / max(1, min(t, lt)), 1 if lc else base), base)

        value = composite(*total)
        if page.names[node] not in inline:
            assert density[node] == pytest.approx(value)
            assert sums[node] == pytest.approx(sum(parts) + composite(*loose))
        return total, loose, value

    share = 5 / 17
    figures(nested(page))


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", "<article>a</article>", "x", 9), (1, "u", "<article>a</article>", "x", 9), (None, None, None, None, None), (2, "", "", "old", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `n.chars` int")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "html", "n.chars", "text", "n_chars"]
    got = sorted((tuple(r) for r in out.select("page_id", "url", "text", "n_chars").collect()), key=repr)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0), (None, None, "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)[1]
        assert got[r["page_id"]] == " ".join(unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())
