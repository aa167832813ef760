"""Operator 3: main-text extraction by line-block distribution.

Markup is stripped into blocks, one line each. Lines inside menus, forms, scripts, adverts, comments and other page
furniture, as elements, roles and the last telling part of class names say, are blank. The lengths of the other lines, less their link text,
are summed over sliding windows of lines. Text starts where the sum surges above a threshold and ends where it dives to
nothing; the lines between are the main text. A heading just before a surge belongs to it, and lines before a heading
do not that are short for their page.

An outermost <article> or <main> is a hint of a boundary and of weight, on a page that surges and dives like any other:
its link text counts, windows do not cross its edges, a first surge inside it starts the text at its opening, and that
text ends with it at the latest. Without a surge it is no text, and what surges outside it is. Beside one that surges,
text outside is main text only if one of its blocks is longer than all that the articles have: readers' comments below an
article go, whatever they are called, and a teaser in an article element hides no long text.

Within a stretch of main text, a div or section whose class says nothing of content is an island if one box has most of
the stretch's text and this one is not around it: adverts and comments of any name. Classes that name content, or how a
page is built, and elements without a class are no islands.

White space (as Unicode has it) inside a block becomes one space; ``<br>`` is white space. Character references are
decoded after markup is gone, so that escaped markup stays as text. Defined results: a null or empty page, and one
without main text, gives the empty string. Unclosed elements end with their parent; a lone ``<`` is text. Furniture
that never closes hides nothing after its own tag; after a quote that never closes, quotes are plain characters. The
time is in proportion to the page's length. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, without

#: Lines of a window, and the window's characters at which text starts (or half of the page's best window, if less).
LINES, SURGE = 3, 86

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the tag's end; a ``>`` within quotes does not end it.
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*+)")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math", "select", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "head", "fieldset", "header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus sidebar sidenav menu nav navbar "
    "navigation discussion discussions thread threads opinions talkback bnr breadcrumb breadcrumbs footer header masthead topbar related recommended share sharing social widget pagination pager toolbar search skip".split()
)
#: Parts of a class name that say how an element is built, not what it is.
_BUILD = set(
    "area bar block body box btn button buttons card cell col column container content frame group holder icons inner item items layout link links list module outer "
    "panel posts articles stories row section slot strip text unit wrap wrapper zone".split()
)
#: Words of class names that name content; with _BUILD, those that make no island.
_CONTENT = set(
    "abstract answer article attachment author blockquote body byline caption center chapter clearfix code content copy date definition desc description details entry equation example excerpt faq "
    "figure footnote footnotes gallery grid headline heading highlight hentry image images img info ingredients instructions intro intertitle kicker lang lead left lede lyrics main math media meta "
    "mw note overview page para paragraph part photo picture poem post prose question quote pullquote recipe right source spec specs standfirst step steps story subtitle summary "
    "table tabs tip title transcript translation verse video warning".split()
)
#: Share of a stretch's characters that one box must have for others to be islands in it.
MOST = 0.6
#: Elements that an opening tag of the same group, or any block, ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_WHOLE = {"html", "body", "main", "article"}


def _names_furniture(word: str, in_article: bool) -> bool:
    """Whether a class or id names page furniture: its last part does that is no number and no part of the build."""
    parts = [x.lower() for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", word) if x]
    if not parts or parts[0] in ("has", "with", "no", "is") or (in_article and parts[-1] == "header"):
        return False
    while len(parts) > 1 and (parts[-1] in _BUILD or parts[-1][0].isdigit()):
        parts.pop()
    return parts[-1].rstrip("0123456789") in _NAMES


def _furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _FURNITURE and not (tag == "header" and in_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            return True
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*+:\s*+none", value):
            return True
        if name in ("class", "id") and any(_names_furniture(word, in_article) for word in value.split()):
            return True
    return False


def _is_box(tag: str, attrs: str) -> bool:
    """Whether an element is a box of its own: a div or section with a class, none of whose words names content."""
    if tag not in ("div", "section") or not attrs:
        return False
    words = [w for name, a, b, c in _ATTR.findall(attrs) if name.lower() == "class" for w in (a or b or c).split()]
    parts = [x.lower().rstrip("0123456789") for w in words for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", w)]
    return any(parts) and not any(x in _CONTENT or x in _BUILD for x in parts)


class _Page:
    """Lines of a page: (text, link characters, is heading, number of the outermost article or 0, is furniture), and the
    number of the box that each lies in, or 0.

    Every step looks at its own tag: open elements are counted by name, the open blocks have a stack of their own and the
    last closing tag of each name is found once, so the time is in proportion to the page whatever it holds.
    """

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self.text: list[str] = []
        self.links = 0
        self.stack: list[tuple[str, bool]] = []  # open elements, and whether each is furniture
        self.open: dict[str, int] = {}
        self.blocks: list[int] = []  # places of blocks in the stack
        self.hidden = self.articles = self.anchors = self.marks = 0
        self.boxes: list[tuple[int, int]] = []  # places of boxes in the stack, and their numbers
        self.around: list[int] = [0]  # by a box's number that of the one around it
        self.box: list[int] = []  # by line
        self.source, self.low, self.last = source, None, None
        self._read(source)
        self._break()

    def _read(self, source: str) -> None:
        at, n, quotes = 0, len(source), True
        while at < n:
            start = source.find("<", at)
            if start < 0:
                break
            self._add(source[at:start])
            at = start
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith("<![CDATA[", start):
                end = source.find("]]>", start)
                at = n if end < 0 else end + 3
                continue
            name = _NAME.match(source, start + 1)
            if not name and not source.startswith(("<!", "<?"), start):
                self._add("<")
                at = start + 1
                continue
            m = _QUOTED.match(source, name.end()) if name and quotes else None
            end = m.end() if m else source.find(">", start) + 1
            if not end:  # no tag ends from here on
                break
            if name and quotes and not m:  # a quote never closes: from here on quotes are plain characters
                quotes = False
            at = end
            if name:
                at = self._tag(name[1], name[2].lower(), source[name.end() : end - 1], end)
        self._add(source[at:])

    def _tag(self, close: str, tag: str, attrs: str, at: int) -> int:
        """Takes a tag that ends at ``at``; returns where reading goes on."""
        if close:
            self._close(tag)
        elif tag in _RAW and not attrs.endswith("/"):
            self.low = self.low or self.source.lower()
            end = self.low.find(f"</{tag}", at)
            return len(self.source) if end < 0 else end
        else:
            self._open(tag, attrs, at)
        return at

    def _closes(self, tag: str, at: int) -> bool:
        if self.last is None:
            self.last = {m[1].lower(): m.start() for m in _CLOSE.finditer(self.source)}
        return self.last.get(tag, -1) >= at

    def _add(self, text: str) -> None:
        self.text.append(text)
        if self.anchors:
            self.links += len(text.strip())

    def _break(self) -> None:
        text = " ".join(_html.unescape("".join(self.text)).split())
        self.text.clear()
        if text:
            heading = any(t in _HEADING for t, _ in self.stack[-3:])
            self.lines.append((text, min(self.links, len(text)), heading, self.marks if self.articles else 0, self.hidden > 0))
            self.box.append(self.boxes[-1][1] if self.boxes else 0)
        self.links = 0

    def _pop(self) -> None:
        tag, hides = self.stack.pop()
        self.open[tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        if self.boxes and self.boxes[-1][0] == len(self.stack):
            self.boxes.pop()
        self.hidden -= hides
        self.articles -= tag in ("article", "main")
        self.anchors -= tag == "a"

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._break()
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def _open(self, tag: str, attrs: str, at: int) -> None:
        if tag == "br":
            self._add(" ")
            return
        if tag in _BLOCK:
            self._break()
            inner = self.blocks[-1] if self.blocks else None
            if inner is not None and (self.stack[inner][0] == "p" or tag in _ENDS.get(self.stack[inner][0], ())):
                while len(self.stack) > inner:
                    self._pop()
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            return
        hides = _furniture(tag, attrs, self.articles > 0)
        if hides and tag not in ("p", "li", "td", "tr", "th", "dd", "dt") and not self._closes(tag, at):
            hides = False  # it never closes: what follows is not its own
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        if _is_box(tag, attrs) and self._closes(tag, at):
            self.around.append(self.boxes[-1][1] if self.boxes else 0)
            self.boxes.append((len(self.stack), len(self.around) - 1))
        self.stack.append((tag, hides))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += hides
        self.marks += not self.articles and tag in ("article", "main")
        self.articles += tag in ("article", "main")
        self.anchors += tag == "a"


def extract(source: str | None, *, lines: int = LINES, surge: int = SURGE) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = _Page(source)
    found = page.lines
    shown = [not hidden for *_, hidden in found]
    mark = [article for _, _, _, article, _ in found]
    weight = [len(text) - (0 if article else links) if show else 0 for (text, links, _, article, _), show in zip(found, shown, strict=True)]
    sums = [sum(w for w, m in zip(weight[i : i + lines], mark[i : i + lines], strict=True) if m == mark[i]) for i in range(len(weight))]
    best = max(sums, default=0)
    if not best:
        return ""
    threshold = min(surge, best / 2)
    usual = sum(w * w for w in weight) / sum(weight)  # the length of the block that a character of the page lies in
    kept: set[int] = set()
    stretches: list[tuple[int, list[int]]] = []
    i = 0
    while i < len(sums):
        if sums[i] <= threshold or not weight[i]:
            i += 1
            continue
        start, inside = i, mark[i]
        while inside and start and mark[start - 1] == inside and start - 1 not in kept:
            start -= 1
        while start and found[start - 1][2] and shown[start - 1] and start - 1 not in kept:
            start -= 1
        # The window reaches ahead of the surge. Text starts at a heading in it if what comes before is short for this page,
        # and short lines before the first long one are not yet text.
        head = next((k for k in range(i, min(i + lines, len(found))) if found[k][2] and shown[k]), None)
        if not inside and head is not None and start == i and all(w < usual / 2 for w in weight[i:head]):
            start = head
        while not inside and start < i + lines - 1 and not found[start][2] and weight[start] < threshold / lines:
            start += 1
        # A short element within text that surged outside it belongs to that text.
        while i < len(sums) and (mark[i] == inside and sums[i] if inside else any(weight[i : i + lines])):
            i += 1
        kept.update(range(start, i))
        stretches.append((inside, [k for k in range(start, i) if shown[k]]))
    marked = sum(weight[k] for inside, rows in stretches if inside for k in rows)
    stretches = [(inside, rows) for inside, rows in stretches if inside or max((weight[k] for k in rows), default=0) > marked]
    lines_ = sorted(k for _, rows in stretches for k in _without_islands(page, rows))
    return "\n".join(found[k][0] for k in lines_)


def _without_islands(page: _Page, rows: list[int]) -> list[int]:
    """The lines of a stretch without those in boxes that stand in, or beside, the one that has most of its text."""
    size: dict[int, int] = {}
    for k in rows:
        size[page.box[k]] = size.get(page.box[k], 0) + len(page.lines[k][0])
    most = max(size, key=size.get, default=0)
    if len(size) < 2 or size[most] < MOST * sum(size.values()):
        return rows
    fine, at = {most}, most
    while at:
        at = page.around[at]
        fine.add(at)
    return [k for k in rows if page.box[k] in fine]


def extract_text(pages: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without its html, plus ``out``: one pass without a shuffle."""
    pages = without(pages, *({out} - {html}))
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(b.schema.get_field_index(html))]
            columns = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*(f.name for f in kept), out])

    return pages.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


SQL = None  # open elements and surges have no SQL form; tests hold the texts against a parser's reading of the pages
