"""Main text of web pages: a small DOM, composite text density per node, the subtree of the largest density sum."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnlake.llm.hashing import slices

# Element names as HTML defines them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends an open element of its row, unless one of the right-hand elements lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An end tag looks no further out than these.
SCOPE = set("table td th caption button object template".split())

# What is never part of an article.
DROPPED = set(
    "head script style noscript template iframe object embed applet audio video canvas svg math nav aside footer form fieldset button select "
    "option textarea input datalist dialog menu search noframes noembed xmp title".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that name such a part.
PART_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promoted promotion outbrain taboola "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer sidebar aside rail cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended "
    "recommendations comment comments respond disqus reply replies".split()
)
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: A class made of these words only, "header" or "masthead" among them, is the page's header.
HEADER_WORDS = set("header masthead site page top main global".split())
#: A class that starts so tells of a part elsewhere.
ABOUT = set("has no with without is hide show".split())
KEEPERS = {"article", "main"}
#: Blocks kept beside the chosen subtree if they hold no link.
PLAIN_BLOCKS = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Open elements; deeper ones become siblings, as in browsers.
MAX_DEPTH = 512

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|</[^A-Za-z>][^>]*(?:>|\Z)|</>"
    r"""|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?P<closed>>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Page:
    """A page's nodes in page order: 0 is the root, a node's subtree is ``node .. last[node]``.

    Text belongs to the node whose start precedes it; ``texts`` holds (node, text) in page order, and
    borders of blocks are texts of one space.
    """

    def __init__(self, source: str):
        self.names, self.parents, self.attrs, self.last = ["#root"], [-1], [""], [0]
        self.texts: list[tuple[int, str]] = []
        self._open = [0]
        at = 0
        for token in iter(lambda: TOKEN.search(source, at), None):
            self._text(source[at : token.start()])
            at = token.end()
            if name := token["start"]:
                name = name.lower()
                if token["closed"]:  # a tag that the page's end cuts off is none
                    self._start(name, token["attrs"])
                    if name in RAW and self._open[-1]:
                        stop = RAW_END[name].search(source, at)
                        if name == "textarea":
                            self._text(source[at : stop.start() if stop else len(source)])
                        at = stop.end() if stop else len(source)
                        self._close(len(self._open) - 1)
            elif name := token["end"]:
                self._end(name.lower())
        self._text(source[at:])
        while len(self._open) > 1:
            self._close(len(self._open) - 1)
        self.last[0] = len(self.names) - 1

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._open[-1], html.unescape(text) if "&" in text else text))

    def _border(self, name: str) -> None:
        if name not in INLINE:
            self.texts.append((self._open[-1], " "))

    def _close(self, depth: int) -> None:
        """End the open elements from ``depth`` on."""
        for node in reversed(self._open[depth:]):
            self.last[node] = len(self.names) - 1
            if self.names[node] not in INLINE:
                self.texts.append((node, " "))
        del self._open[depth:]

    def _find(self, names: set[str], walls: set[str]) -> int:
        """Depth of the innermost open element of ``names`` that no wall hides, else 0."""
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.names[self._open[depth]]
            if name in names:
                return depth
            if name in walls:
                return 0
        return 0

    def _start(self, name: str, attrs: str) -> None:
        if name in ("html", "body", "head") and name in map(self.names.__getitem__, self._open):
            return
        if name in CLOSES_P and (depth := self._find({"p"}, SCOPE)):
            self._close(depth)
        if name in IMPLIED_END:
            ends, walls = IMPLIED_END[name]
            while depth := self._find(ends, walls):
                self._close(depth)
        self._border(name)
        node = len(self.names)
        self.names.append(name)
        self.parents.append(self._open[-1])
        self.attrs.append(attrs)
        self.last.append(node)
        if name not in VOID and (len(self._open) < MAX_DEPTH or name in RAW):
            self._open.append(node)

    def _end(self, name: str) -> None:
        if name == "br":
            self._start("br", "")
            return
        depth = self._find({name}, SCOPE - {name})
        # An inline end tag does not end the blocks that were opened inside its element.
        if depth and not (name in INLINE and any(self.names[n] not in INLINE for n in self._open[depth:])):
            self._close(depth)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def _class_words(attrs: dict[str, str]) -> list[list[str]]:
    """Lower-case words of every class and of the id."""
    names = [*attrs.get("class", "").split(), attrs.get("id", "")]
    found = ([w.lower() for w in PART.findall(name)] for name in names)
    return [words for words in found if words and words[0] not in ABOUT]


def _marks(page: Page) -> tuple[list[str], list[int]]:
    """Per node: "sure" (never part of an article), "comments", "named", "header" or ""; and the nodes marked as article or main part."""
    marks, keepers = [], []
    for k, (name, raw) in enumerate(zip(page.names, page.attrs, strict=True)):
        if len(raw) < 2:
            marks.append("sure" if name in DROPPED else "header" if name == "header" else "")
            if name in KEEPERS:
                keepers.append(k)
            continue
        attrs = _attributes(raw)
        classes = _class_words(attrs) if "class" in attrs or "id" in attrs else []
        words = set().union(*classes)
        role = attrs.get("role", "").strip().lower()
        comments = bool(words & COMMENT_WORDS) or attrs.get("itemtype", "").rstrip("/").endswith("/Comment")
        keeper = (name in KEEPERS or role in ("main", "article") or attrs.get("itemprop") == "articleBody") and not comments
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style", "")))
        header = any(set(c) <= HEADER_WORDS and {"header", "masthead"} & set(c) for c in classes)
        if name in ("html", "body", "#root"):
            marks.append("")
        elif name in DROPPED or hidden:
            marks.append("sure")
        elif keeper:
            marks.append("")
            keepers.append(k)
        elif comments:
            marks.append("comments")
        elif words & PART_WORDS or role in DROPPED_ROLES:
            marks.append("named")
        else:
            marks.append("header" if name == "header" or header else "")
    return marks, keepers


def _main_part(page: Page, marks: list[str], keepers: list[int]) -> int:
    """Of the marked articles and main parts the one with most text, outside comments if there is one; else -1."""
    if not keepers:
        return -1
    n = len(marks)
    size, rank = [0] * n, [0] * n
    for node, text in page.texts:
        size[node] += len(text)
    for k in range(n - 1, 0, -1):
        if marks[k] == "sure":
            size[k] = 0
        size[page.parents[k]] += size[k]
    for k in range(1, n):
        own = 2 if marks[k] == "sure" else 1 if marks[k] == "comments" else 0
        rank[k] = max(own, rank[page.parents[k]])
    best = min(keepers, key=lambda k: (rank[k], -size[k] if rank[k] == 0 else 0, k))
    return best if rank[best] < 2 else -1


def boilerplate(page: Page, named: bool = True) -> list[bool]:
    """Nodes that lie in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments.

    Elements made for such parts always go; with ``named`` those go too that a class, id or role names so,
    unless they hold the page's main part. A header inside an article or main part is its own.
    """
    marks, keepers = _marks(page)
    main = _main_part(page, marks, keepers)
    is_keeper = set(keepers)
    n = len(marks)
    gone, inside = [False] * n, [False] * n
    for k in range(1, n):
        up = page.parents[k]
        inside[k] = inside[up] or up in is_keeper
        own = marks[k] == "sure"
        if named and marks[k] and not own and not (marks[k] == "header" and inside[k]):
            own = not k <= main <= page.last[k]
        gone[k] = gone[up] or own
    return gone


def _adjusted(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, lowered by links: their log-ratio to a base that grows with links here and on the page.

    Text without links weighs its characters per tag at least, links alone weigh nothing.
    """
    tags = max(1, tags)
    base = max(math.e, math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e))
    spread = chars / max(1, link_chars) * tags / max(1, min(tags, link_tags))
    return chars / tags * math.log(max(1.0 if link_chars else base, spread)) / math.log(base)


def densities(page: Page, gone: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Per node: composite text density, density sum, and link characters, over what is not ``gone``.

    Density is characters per tag below the node, adjusted by links. The sum of a node is that of its
    block children; text outside them (inline elements included) counts as one child more, so that a
    block without blocks has its own density as the sum. Inline elements have none.
    """
    n = len(page.names)
    totals = [[0, 0, 0, 0] for _ in range(n)]  # characters, tags, link characters, link tags
    loose = [[0, 0, 0, 0] for _ in range(n)]  # of these, what is outside the node's block children
    in_link, block = [False] * n, [0] * n
    for k in range(1, n):
        link = page.names[k] == "a"
        inline = page.names[k] in INLINE
        in_link[k] = in_link[page.parents[k]] or link
        block[k] = block[page.parents[k]] if inline else k
        if not gone[k]:
            totals[k][1], totals[k][3] = 1, int(link)
            if inline:
                loose[block[k]][1] += 1
                loose[block[k]][3] += int(link)
    page_chars = page_links = 0
    for node, text in page.texts:
        size = sum(map(len, text.split()))
        links = size if in_link[node] else 0
        page_chars, page_links = page_chars + size, page_links + links
        if not gone[node]:
            for counts in (totals[node], loose[block[node]]):
                counts[0] += size
                counts[2] += links
    share = page_links / max(1, page_chars)
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        chars, tags, link_chars, link_tags = totals[k]
        if k:
            above = totals[page.parents[k]]
            above[0] += chars
            above[1] += tags
            above[2] += link_chars
            above[3] += link_tags
        if not chars or gone[k] or block[k] != k:
            continue
        own_tag, own_link = (1, int(page.names[k] == "a")) if k else (0, 0)
        density[k] = _adjusted(chars, tags - own_tag, link_chars, link_tags - own_link, share)
        if loose[k][0]:
            sums[k] += _adjusted(*loose[k], share)
        if k:
            up = block[page.parents[k]]
            sums[up] += density[k]
    return density, sums, [t[2] for t in totals]


def _path(page: Page, node: int, body: int) -> list[int]:
    """``node`` and the nodes above it, the body last."""
    out = [node]
    while out[-1] not in (body, 0):
        out.append(page.parents[out[-1]])
    return out


def selected(page: Page, gone: list[bool]) -> list[bool]:
    """Nodes whose text is the page's main text.

    The block of the largest density sum (the outer one of equals) leads: where it lies in an article or
    main part, the outermost of them is the text. Elsewhere the least density on the path from it to the
    body is the threshold; walking down from the body through blocks that reach it, the block of the
    largest sum below each is taken, and so are headings and paragraphs without links beside the path.
    """
    n = len(page.names)
    density, sums, links = densities(page, gone)
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        if not gone[k] and (sums[best[k]], -best[k]) > (sums[best[up]], -best[up]):
            best[up] = best[k]
    body = next((k for k in range(n) if page.names[k] == "body" and not gone[k]), 0)
    lead = best[body]
    if not sums[lead]:  # nothing but links, if anything
        main = _main_part(page, *_marks(page))
        lead = main if main > 0 and not gone[main] else lead
    path = _path(page, lead, body)
    marked = [k for k in path if page.names[k] in KEEPERS]
    if marked:
        spans = [marked[-1]]
    else:
        threshold = min(density[k] for k in path)
        reached, spans, beside = [False] * n, [], set(path)
        for k in range(body, page.last[body] + 1):
            if gone[k] or page.names[k] in INLINE:
                continue
            reached[k] = density[k] >= threshold > 0 and (k == body or reached[page.parents[k]])
            if reached[k]:
                spans.append(best[k])
            elif page.parents[k] in beside and page.names[k] in PLAIN_BLOCKS and not links[k]:
                spans.append(k)
    taken = [False] * n
    for k in spans:
        if not taken[k]:
            for j in range(k, page.last[k] + 1):
                taken[j] = not gone[j]
    return taken


def main_text(source: str | None) -> str:
    """The article of a page in one line; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    for named in (True, False):  # names that leave nothing mislead
        taken = selected(page, boilerplate(page, named))
        text = " ".join("".join(text for node, text in page.texts if taken[node]).split())
        if text:
            return text
    return ""


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with two columns more, text and n_chars: the main text of every whole page and its code points.

    Text is decoded and any run of white space in a block (as Unicode has it, no-break spaces included) is
    one space; blocks are joined by one. A null or empty page, or one without a main part, gives an empty
    text. Columns of these names are replaced; each row, repeated or not, is read by itself, so nothing is
    shuffled and one long page is one row of a task. An empty table gives no rows.
    """
    own = [(f"c{k}", f) for k, f in enumerate(pages.schema.fields) if f.name not in ("text", "n_chars")]
    source = next(plain for plain, f in own if f.name == html_column)
    plain = [name for name, _ in own]

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                texts = [main_text(x) for x in part.column(source).to_pylist()]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), *new], names=[*plain, "text", "n_chars"])

    schema = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in own)
    # Any name may stand in the table, dots and all: columns go by place.
    by_place = pages.toDF(*[f"c{k}" for k in range(len(pages.columns))]).select(*plain)
    return by_place.mapInArrow(run, schema + ", text string, n_chars long").toDF(*[f.name for _, f in own], "text", "n_chars")
