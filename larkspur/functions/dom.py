"""A small forgiving DOM on the standard library's tokenizer: implied end tags, void elements, simple queries."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag ends open elements of these names, up to the nearest container.
CLOSES = {
    "p": {"p"},
    "li": {"li", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "option": {"option"},
    **{t: {"p"} for t in ("div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "hr", "blockquote")},
    **{t: {"thead", "tbody", "tfoot", "tr", "td", "th", "p"} for t in ("thead", "tbody", "tfoot")},
}
STOPS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def classes(self) -> str:
        return self.attrs.get("class") or ""

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        """Descendants in document order."""
        stack = [iter(self.elements())]
        while stack:
            e = next(stack[-1], None)
            if e is None:
                stack.pop()
                continue
            yield e
            stack.append(iter(e.elements()))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return "".join(out)

    def first(self, test) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def has_class(self, name: str) -> bool:
        return name in self.classes.split()

    def by_class(self, name: str) -> Element | None:
        return self.first(lambda e: e.has_class(name))


class _Builder(HTMLParser):
    def __init__(self, strict_tree: bool):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root")
        self.imply = strict_tree

    def handle_starttag(self, tag, attrs):
        if self.imply and tag in CLOSES:
            x, last = self.at, None
            while x.parent is not None and x.tag not in STOPS.get(tag, {"div", "td", "th", "li", "section", "article", "body"}):
                if x.tag in CLOSES[tag]:
                    last = x
                x = x.parent
            if last is not None:
                self.at = last.parent
        e = Element(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def parse(html: str | None, implied: bool = True) -> Element:
    """The tree of a page, or of a fragment of markup (implied=False: tags nest just as written)."""
    b = _Builder(implied)
    b.feed(html or "")
    b.close()
    return b.root
