"""Pages as trees of elements: spans of one list of texts, so that no text is stored twice.

Every element is a node (tag, id, first text, text after the last one) and a stack holds all open ones. A parent's
end tag closes what is still open in it; elements whose end tag may be left out (paragraphs, list items, cells, options)
end where the next of their kind or a block begins, so unclosed siblings are siblings, not each other's children. At most
DEEPEST elements are open: a deeper one takes the place of the deepest. So a page is read in linear time, and the
texts of its elements together hold each character at most DEEPEST times, however broken it is.
"""

from __future__ import annotations

from html.parser import HTMLParser

DEEPEST = 256
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_LISTS, _TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("td", "th", "tr"))
#: start tag -> (open elements that it ends, elements that shield those outside them)
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELLS, _TABLE),
    "th": (_CELLS, _TABLE),
    "tr": (_ROWS, _TABLE),
    **{t: (_ROWS | {"thead", "tbody", "tfoot"}, _TABLE) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    **{f"h{k}": (frozenset(f"h{j}" for j in range(1, 7)), frozenset(("div", "section", "article", "table", "li"))) for k in range(1, 7)},
}
#: A block ends an open paragraph, unless one of these stands between.
_SHIELDS = frozenset(("table", "td", "th", "caption", "button", "object", "template"))


class Node:
    __slots__ = ("anchor", "first", "last", "tag")

    def __init__(self, tag: str, anchor: str, first: int):
        self.tag, self.anchor, self.first, self.last = tag, anchor, first, first


class Page(HTMLParser):
    """``nodes``: all visible elements in the order of their start tags; ``texts``: the visible texts, stripped."""

    def __init__(self, html: str | None, hidden: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.hidden, self.under = hidden, 0
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self.title: str | None = None
        self.og_title = ""
        self._open: list[Node] = []
        self._count: dict[str, int] = {}
        self._data: list[str] = []
        self.feed(html or "")
        self.close()
        self._flush()
        while self._open:
            self._end()

    def _flush(self) -> None:
        """A text ends at every tag, comment and declaration."""
        if self._data:
            text = "".join(self._data).strip()
            self._data.clear()
            if text and not self.under:
                if self.title is None and self._open and self._open[-1].tag == "title":
                    self.title = text
                self.texts.append(text)

    def _end(self) -> None:
        node = self._open.pop()
        node.last = len(self.texts)
        self._count[node.tag] -= 1
        self.under -= node.tag in self.hidden

    def _end_until(self, tags: frozenset[str], shields: frozenset[str]) -> None:
        """Ends the nearest open element of these tags that no shield hides, with what is in it."""
        if any(self._count.get(t) for t in tags):
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k].tag in tags:
                    while len(self._open) > k:
                        self._end()
                    return
                if self._open[k].tag in shields or self._open[k].tag in self.hidden:
                    return

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "meta" and not self.og_title:
            at = dict(attrs)
            if at.get("property") == "og:title":
                self.og_title = at.get("content") or ""
        if tag in _BLOCKS:
            self._end_until(frozenset(("p",)), _SHIELDS)
        if tag in _ENDS:
            self._end_until(*_ENDS[tag])
        if tag in _VOID:
            return
        if len(self._open) >= DEEPEST:
            self._end()
        node = Node(tag, dict(attrs).get("id") or "", len(self.texts))
        self._open.append(node)
        self._count[tag] = self._count.get(tag, 0) + 1
        self.under += tag in self.hidden
        if not self.under:
            self.nodes.append(node)

    def handle_endtag(self, tag):
        self._flush()
        if self._count.get(tag):
            while self._open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        self._data.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    handle_pi = unknown_decl = handle_decl

    def text(self, node: Node, by: str = " ") -> str:
        return by.join(self.texts[node.first : node.last])


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def main_text_of(html: str | None) -> str:
    """Title, top headings and paragraphs, one a line, without navigation and scripts."""
    page = Page(html, frozenset(("script", "style", "nav", "footer", "header", "noscript")))
    found = (page.text(n) for n in page.nodes if n.tag in ("h1", "h2", "h3", "p"))
    return "\n".join(x for x in [page.title or "", *found] if x).strip()


def title_body_of(html: str | None) -> tuple[str, str]:
    """The title (else og:title), and the longest text of the first main, the first article and 50 sections; else all. White space is single."""
    page = Page(html, frozenset(("script", "style", "template")))
    first = [next((n for n in page.nodes if n.tag == t), None) for t in ("main", "article")]
    some = [n for n in first if n] + [n for n in page.nodes if n.tag in ("section", "div")][:50]
    clean = [" ".join(t.split()) for t in page.texts]
    ends = [0]
    for t in clean:
        ends.append(ends[-1] + len(t) + 1)
    best = max(some, key=lambda n: ends[n.last] - ends[n.first], default=None)
    body = " ".join(clean[best.first : best.last]) if best else ""
    return " ".join((page.title or page.og_title).split()), body or " ".join(clean)


def sections_of(html: str | None) -> list[dict]:
    """Sections opened by headings, with the text of paragraphs and list items; an item's text holds that of the items in it, which follow as well."""
    page = Page(html, frozenset(("script", "style", "noscript")))
    out, now = [], {"title": "(intro)", "text": [], "anchors": []}
    for n in page.nodes:
        if n.tag in _HEADINGS:
            if now["text"]:
                out.append(now)
            now = {"title": page.text(n) or "(untitled)", "text": [], "anchors": [n.anchor] if n.anchor else []}
        elif n.tag in ("p", "li") and (text := page.text(n)):
            now["text"].append(text)
    if now["text"]:
        out.append(now)
    if not out and page.texts:
        out = [{"title": "(document)", "text": page.texts, "anchors": []}]
    return [{**s, "text": "\n".join(s["text"])} for s in out]


def without_blobs(text: str, keys: tuple[str, ...]) -> str:
    """Braces whose content names a key are cut out with it, the inner ones first, until none is left; one key after the other.

    Each pass is one walk with a stack of open braces; what is cut from an inner blob is gone when the outer one is looked at.
    """
    for key in keys:
        if key not in text:
            continue
        out: list[str] = []
        stack: list[list] = []  # [place of the brace in ``out``, whether braces are left inside]
        last = 0
        for at, c in ((k, ch) for k, ch in enumerate(text) if ch in "{}"):
            out.append(text[last:at])
            last = at + 1
            if c == "{":
                stack.append([len(out), False])
                out.append("{")
            elif not stack:
                out.append("}")
            else:
                place, braces = stack.pop()
                out.append("}")
                if not braces and key in (blob := "".join(out[place:])):
                    del out[place:]
                else:
                    if not braces:
                        out[place:] = [blob]
                    if stack:
                        stack[-1][1] = True
        out.append(text[last:])
        text = "".join(out)
    return text
