"""Document trees: markup both ways, HTML, walks, repairs, and tables of nodes.

A tree is a list of blocks; a block is an object with a type.  One grammar table
says for each type which tag, attributes, slots and children it has; writing,
reading, walking and comparing all follow that table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html import escape as _html_escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from ..functions.dom import Element, parse as parse_dom


class Kind:
    """How one node type is written.

    attrs: (field, attribute, form) with form text, flag, number or json.
    slots: (field, tag, content) before the children; content is text, inline, blocks or lines.
    content: inline, blocks, mixed, none, or text (then `text_field` holds it).
    """

    def __init__(self, tag, attrs=(), content="none", slots=(), inline=False, void=False, text_field=None, items=None):
        self.tag, self.attrs, self.content, self.slots = tag, attrs, content, slots
        self.inline, self.void, self.text_field, self.items = inline, void, text_field, items


def _text(*names):
    return tuple((n, n.lower(), "text") for n in names)


# Types, tags, attributes and fields of the markup as stored.
KINDS: dict[str, Kind] = {
    "break": Kind("br", inline=True, void=True),
    "strong": Kind("strong", content="inline", inline=True),
    "emphasis": Kind("em", content="inline", inline=True),
    "color": Kind("color", _text("value"), "inline", inline=True),
    "link": Kind("a", (*_text("href"), ("external", "external", "flag")), "inline", inline=True),
    "badge": Kind("badge", _text("variant"), "text", inline=True, text_field="text"),
    "icon": Kind("icon", _text("src", "alt"), inline=True),
    "time": Kind("time", _text("datetime"), "inline", inline=True),
    "event": Kind("event", _text("id", "start", "end"), "inline", inline=True),
    "paragraph": Kind("p", _text("align"), "inline"),
    "heading": Kind("h", _text("variant", "anchor"), "inline"),
    "button": Kind("button", _text("href", "variant"), "inline"),
    "divider": Kind("hr", void=True),
    "image": Kind("img", (*_text("src", "alt", "variant", "href"), ("external", "external", "flag"), ("sources", "sources", "json")), slots=(("text", "line", "lines"), ("caption", "figcaption", "inline"))),
    "video": Kind("video", _text("provider", "src"), slots=(("caption", "figcaption", "inline"),)),
    "embed": Kind("embed", _text("provider", "variant", "content"), void=True),
    "infoBox": Kind("infobox", _text("variant"), "mixed"),
    "section": Kind("section", _text("variant"), "mixed", (("title", "sectiontitle", "inline"), ("dateline", "dateline", "inline"))),
    "accordion": Kind("accordion", (), "mixed", (("summary", "summary", "inline"),)),
    "speechBubble": Kind("speech", _text("icon"), "mixed", (("speaker", "speaker", "text"),)),
    "messageBox": Kind("message", (), "mixed", (("name", "name", "text"), ("role", "role", "text"))),
    "list": Kind("ul", _text("variant"), items=("items", "li", (), "mixed")),
    "table": Kind("table", _text("variant")),
    "interview": Kind("interview", (), slots=(("title", "inttitle", "text"), ("writer", "writer", "text"))),
    "steps": Kind("steps", _text("variant"), items=("items", "step", (("n", "n", "number"),), "blocks")),
    "ranking": Kind("ranking", _text("variant"), items=("items", "rank", (("rank", "n", "number"), ("count", "count", "text")), "title")),
}
BY_TAG = {k.tag: t for t, k in KINDS.items() if k.tag not in ("h", "img", "ul")} | {"img": "image", "figure": "image", "ul": "list", "ol": "list", **{f"h{n}": "heading" for n in range(1, 5)}}
CELL = (("colSpan", "colspan", "number"), ("rowSpan", "rowspan", "number"))


def is_inline(node) -> bool:
    return isinstance(node, str) or KINDS[node["type"]].inline


# -- children, walks, maps -------------------------------------------------


def child_lists(node: dict) -> list[tuple[str, list]]:
    """All lists of child nodes of a node, named, in reading order."""
    kind = KINDS[node["type"]]
    out = [(f, node[f]) for f, _, c in kind.slots if c in ("inline", "blocks") and node.get(f) is not None]
    if "children" in node:
        out.append(("children", node["children"]))
    if kind.items:
        field, _, _, content = kind.items
        for i, item in enumerate(node.get(field, ())):
            name = "title" if content == "title" else "children"
            out.append((f"{field}[{i}].{name}", item[name]))
    if node["type"] == "table":
        rows = ([node["headers"]] if node.get("headers") else []) + node["rows"]
        out += [(f"cell[{r}][{c}]", cell["children"]) for r, row in enumerate(rows) for c, cell in enumerate(row)]
    if node["type"] == "interview":
        for i, e in enumerate(node["exchanges"]):
            out += [(f"exchanges[{i}].question", e["question"]), (f"exchanges[{i}].answer", e["answer"])]
    return out


def walk(nodes: list) -> Iterator:
    """All nodes, texts too, parents first."""
    stack = [iter(nodes)]
    while stack:
        n = next(stack[-1], stack)
        if n is stack:
            stack.pop()
            continue
        yield n
        if not isinstance(n, str):
            stack.append(iter([c for _, own in child_lists(n) for c in own]))


def map_lists(nodes: list, f: Callable[[list], list]) -> list:
    """f applied to every list of children, from the leaves up; the input is not changed."""
    copy = json.loads(json.dumps(nodes))

    def visit(own: list) -> list:
        for n in own:
            if not isinstance(n, str):
                for _, inner in child_lists(n):
                    inner[:] = visit(inner)
        return f(own)

    return visit(copy)


def merged_texts(nodes: list) -> list:
    out: list = []
    for n in nodes:
        if isinstance(n, str) and out and isinstance(out[-1], str):
            out[-1] += n
        elif n != "":
            out.append(n)
    return out


def stripped(nodes: list) -> list:
    """Without time and event wrappers; their children take their place."""

    def splice(own):
        return merged_texts([c for n in own for c in (n["children"] if isinstance(n, dict) and n["type"] in ("time", "event") else [n])])

    return map_lists(nodes, splice)


def preserves_content(before: list, after: list) -> bool:
    """The two differ in time and event wrappers only."""
    return to_markup(stripped(before)) == to_markup(stripped(after))


def tag_counts(nodes: list) -> tuple[int, int]:
    types = [n["type"] for n in walk(nodes) if isinstance(n, dict)]
    return types.count("time"), types.count("event")


def images(nodes: list) -> list[str]:
    """Distinct sources of images, icons and speakers, in reading order."""
    found = []
    for n in walk(nodes):
        if isinstance(n, dict):
            found += [n.get("src") if n["type"] in ("image", "icon") else n.get("icon"), *(s.get("src") for s in n.get("sources", ()))]
    return list(dict.fromkeys(x for x in found if x))


# -- markup ----------------------------------------------------------------


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attributes(node: dict, attrs) -> str:
    out = []
    for field, name, form in attrs:
        v = node.get(field)
        if v is None or v is False:
            continue
        if form == "flag":
            out.append(f" {name}")
        else:
            text = json.dumps(v, ensure_ascii=False, separators=(",", ":")) if form == "json" else str(v)
            out.append(f' {name}="{escape_text(text).replace(chr(34), "&quot;")}"')
    return "".join(out)


def to_markup(nodes: list) -> str:
    return "".join(map(_written, nodes))


def _written(node) -> str:
    if isinstance(node, str):
        return escape_text(node)
    kind, tag = KINDS[node["type"]], KINDS[node["type"]].tag
    inner = []
    for field, slot, content in kind.slots:
        v = node.get(field)
        if v is None:
            continue
        for part in v if content == "lines" else [v]:
            inner.append(f"<{slot}>{escape_text(part) if content in ('text', 'lines') else to_markup(part)}</{slot}>")
    if node["type"] == "heading":
        tag = f"h{node['level']}"
    elif node["type"] == "list":
        tag = "ol" if node.get("ordered") else "ul"
    elif node["type"] == "image":
        tag = "figure" if node.get("text") is not None or node.get("caption") is not None else "img"
    head = f"<{tag}{_attributes(node, kind.attrs)}>"
    if kind.void or tag == "img":
        return head
    if kind.text_field:
        inner.append(escape_text(node.get(kind.text_field, "")))
    if "children" in node:
        inner.append(to_markup(node["children"]))
    if kind.items:
        field, item_tag, attrs, content = kind.items
        inner += [f"<{item_tag}{_attributes(i, attrs)}>{to_markup(i['title' if content == 'title' else 'children'])}</{item_tag}>" for i in node.get(field, ())]
    if node["type"] == "table":
        row = lambda cells: "<tr>" + "".join(f"<{'th' if c.get('header') else 'td'}{_attributes(c, CELL)}>{to_markup(c['children'])}</{'th' if c.get('header') else 'td'}>" for c in cells) + "</tr>"
        if node.get("headers"):
            inner.append(f"<thead>{row(node['headers'])}</thead>")
        inner.append(f"<tbody>{''.join(map(row, node['rows']))}</tbody>")
    if node["type"] == "interview":
        inner += [f"<exchange><question>{to_markup(e['question'])}</question><answer>{to_markup(e['answer'])}</answer></exchange>" for e in node["exchanges"]]
    return f"{head}{''.join(inner)}</{tag}>"


class MarkupError(ValueError):
    pass


def from_markup(markup: str, tolerant: bool = False) -> list:
    """The blocks of markup.  An unknown tag is an error, or (tolerant) gives way to its children."""
    root = parse_dom(markup, implied=False)
    return _read_children(root, "blocks", tolerant, ())


def _read_children(e: Element, content: str, tolerant: bool, skip) -> list:
    out = []
    elements = [c for c in e.children if not (isinstance(c, Element) and c.tag in skip)]
    for i, c in enumerate(elements):
        if isinstance(c, str):
            beside = any(isinstance(x, Element) and BY_TAG.get(x.tag) and KINDS[BY_TAG[x.tag]].inline for x in elements[max(0, i - 1) : i + 2])
            if content == "inline" or c.strip() or (content == "mixed" and beside):
                if content == "blocks":
                    if not tolerant:
                        raise MarkupError("text between blocks")
                    out.append({"type": "paragraph", "children": [c.strip()]})
                else:
                    out.append(c)
            continue
        kind = BY_TAG.get(c.tag)
        wanted = kind and (content == "mixed" or KINDS[kind].inline == (content == "inline"))
        if not wanted:
            if not tolerant:
                raise MarkupError(f"<{c.tag}> does not belong in {content}")
            out += _read_children(c, content, tolerant, ())
            continue
        out.append(_read(c, kind, tolerant))
    return merged_texts(out) if content != "blocks" else out


def _fields(e: Element, attrs) -> dict:
    out = {}
    for field, name, form in attrs:
        v = e.get(name)
        if v is not None:
            out[field] = True if form == "flag" else int(v) if form == "number" else json.loads(v) if form == "json" else v
    return out


def _read(e: Element, type_: str, tolerant: bool) -> dict:
    kind = KINDS[type_]
    node: dict = {"type": type_}
    if type_ == "heading":
        node["level"] = int(e.tag[1])
    if type_ == "list":
        node["ordered"] = e.tag == "ol"
    node |= _fields(e, kind.attrs)
    tags = [slot for _, slot, _ in kind.slots]
    for field, slot, content in kind.slots:
        own = [c for c in e.elements() if c.tag == slot]
        if content == "lines":
            if own:
                node[field] = [c.text() for c in own]
        elif own:
            node[field] = own[0].text() if content == "text" else _read_children(own[0], content, tolerant, ())
    if kind.text_field:
        node[kind.text_field] = e.text()
    elif kind.content != "none":
        node["children"] = _read_children(e, kind.content, tolerant, tags)
    if kind.items:
        field, item_tag, attrs, content = kind.items
        node[field] = [_fields(c, attrs) | ({"title": _read_children(c, "inline", tolerant, ())} if content == "title" else {"children": _read_children(c, content, tolerant, ())}) for c in e.elements() if c.tag == item_tag]
    if type_ == "table":
        row = lambda r: [({"header": True} if c.tag == "th" else {}) | _fields(c, CELL) | {"children": _read_children(c, "mixed", tolerant, ())} for c in r.elements() if c.tag in ("td", "th")]
        head = next((c for c in e.elements() if c.tag == "thead"), None)
        if head is not None and head.elements():
            node["headers"] = row(head.elements()[0])
        node["rows"] = [row(r) for body in e.elements() if body.tag == "tbody" for r in body.elements() if r.tag == "tr"]
    if type_ == "interview":
        node["exchanges"] = []
        for x in (c for c in e.elements() if c.tag == "exchange"):
            q, a = (next((c for c in x.elements() if c.tag == t), Element(t)) for t in ("question", "answer"))
            node["exchanges"].append({"question": _read_children(q, "inline", tolerant, ()), "answer": _read_children(a, "blocks", tolerant, ())})
    return node


def valid(nodes: list) -> bool:
    """The tree survives the way to markup and back."""
    try:
        return from_markup(to_markup(nodes)) == nodes
    except (MarkupError, KeyError, TypeError, ValueError):
        return False


# -- HTML ------------------------------------------------------------------

_HTML = {"strong": "strong", "emphasis": "em", "paragraph": "p", "infoBox": "aside", "section": "section", "accordion": "details", "speechBubble": "blockquote", "messageBox": "blockquote"}


def to_html(nodes: list, image_src: Callable[[str], str] = str, link_href: Callable[[str], str] = str) -> str:
    """Display HTML; addresses go through the two resolvers."""
    e = lambda s: _html_escape(str(s), quote=True)

    def one(n) -> str:
        if isinstance(n, str):
            return _html_escape(n, quote=False)
        t = n["type"]
        inner = "".join(map(one, n.get("children", ())))
        if t == "break":
            return "<br>"
        if t == "divider":
            return "<hr>"
        if t == "color":
            return f'<span style="color:{e(n["value"])}">{inner}</span>'
        if t in ("link", "button"):
            rel = ' target="_blank" rel="noopener"' if n.get("external") else ""
            return f'<a href="{e(link_href(n.get("href", "")))}"{rel}>{inner}</a>'
        if t == "badge":
            return f'<span class="badge">{e(n["text"])}</span>'
        if t == "icon":
            return f'<img class="icon" src="{e(image_src(n["src"]))}" alt="{e(n.get("alt", ""))}">'
        if t == "time":
            return f'<time datetime="{e(n["datetime"])}">{inner}</time>'
        if t == "event":
            return f'<time datetime="{e(n["start"])}">{inner}</time>'
        if t == "heading":
            anchor = f' id="{e(n["anchor"])}"' if n.get("anchor") else ""
            return f"<h{n['level']}{anchor}>{inner}</h{n['level']}>"
        if t == "image":
            alt = n.get("alt") or " ".join(n.get("text") or [])
            img = f'<img src="{e(image_src(n["src"]))}" alt="{e(alt)}">'
            img = f'<a href="{e(link_href(n["href"]))}">{img}</a>' if n.get("href") else img
            return f"<figure>{img}<figcaption>{''.join(map(one, n['caption']))}</figcaption></figure>" if n.get("caption") else img
        if t == "video":
            return f'<iframe src="{e(n["src"])}"></iframe>'
        if t == "embed":
            return f"<blockquote>{e(n.get('content', ''))}</blockquote>"
        if t == "list":
            tag = "ol" if n.get("ordered") else "ul"
            return f"<{tag}>{''.join('<li>' + ''.join(map(one, i['children'])) + '</li>' for i in n['items'])}</{tag}>"
        if t == "steps":
            return f"<ol>{''.join('<li>' + ''.join(map(one, i['children'])) + '</li>' for i in n['items'])}</ol>"
        if t == "ranking":
            return "<ol>" + "".join(f'<li value="{i["rank"]}">' + "".join(map(one, i["title"])) + "</li>" for i in n["items"]) + "</ol>"
        if t == "table":
            cell = lambda c: f"<{'th' if c.get('header') else 'td'}{_attributes(c, CELL)}>{''.join(map(one, c['children']))}</{'th' if c.get('header') else 'td'}>"
            row = lambda cells: f"<tr>{''.join(map(cell, cells))}</tr>"
            head = f"<thead>{row(n['headers'])}</thead>" if n.get("headers") else ""
            return f"<table>{head}<tbody>{''.join(map(row, n['rows']))}</tbody></table>"
        if t == "interview":
            return "<dl>" + "".join(f"<dt>{''.join(map(one, x['question']))}</dt><dd>{''.join(map(one, x['answer']))}</dd>" for x in n["exchanges"]) + "</dl>"
        extra = "".join(map(one, n.get("title") or [])) if t == "section" else "".join(map(one, n.get("summary") or []))
        if t == "infoBox" and n.get("variant") == "toc":
            return f"<nav>{inner}</nav>"
        lead = f"<summary>{extra}</summary>" if t == "accordion" else f"<header>{extra}</header>" if extra else ""
        return f"<{_HTML[t]}>{lead}{inner}</{_HTML[t]}>"

    return "".join(map(one, nodes))


# -- repairs ---------------------------------------------------------------

#: Attributes that no translation may change.
FIXED = {t: [f for f, _, _ in k.attrs] for t, k in KINDS.items()}


def reconciled(source: list, drifted: list) -> tuple[list, int, list[str]]:
    """drifted with the source's attributes put back: (tree, repairs, types that diverge).

    Nodes pair by position inside their type; a type whose counts differ is left
    alone and reported.
    """
    out = json.loads(json.dumps(drifted))
    buckets: list[dict[str, list]] = []
    for tree in (source, out):
        own: dict[str, list] = {}
        for n in walk(tree):
            if isinstance(n, dict):
                own.setdefault(n["type"], []).append(n)
        buckets.append(own)
    repairs, divergent = 0, []
    for t in sorted(buckets[0].keys() | buckets[1].keys()):
        a, b = buckets[0].get(t, []), buckets[1].get(t, [])
        if len(a) != len(b):
            divergent.append(t)
            continue
        for x, y in zip(a, b, strict=True):
            for f in FIXED[t]:
                if x.get(f) != y.get(f):
                    repairs += 1
                    if f in x:
                        y[f] = x[f]
                    else:
                        y.pop(f, None)
    return out, repairs, divergent


# -- Spark -----------------------------------------------------------------


def _udf(f: Callable, kind):
    """A vectorised function of text; null in, null out."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


markup_of = _udf(lambda s: to_markup(json.loads(s)), StringType())
html_of = _udf(lambda s: to_html(json.loads(s)), StringType())
stripped_tree = _udf(lambda s: json.dumps(stripped(json.loads(s)), ensure_ascii=False), StringType())
valid_tree = _udf(lambda s: valid(json.loads(s)), BooleanType())
image_urls = _udf(lambda s: images(json.loads(s)), ArrayType(StringType()))


def _tolerant(s: str) -> str | None:
    try:
        return json.dumps(from_markup(s, tolerant=True), ensure_ascii=False)
    except ValueError:
        return None


def _strict(s: str) -> str | None:
    try:
        return json.dumps(from_markup(s), ensure_ascii=False)
    except ValueError:
        return None


#: Null where the markup is not valid.
tree_of = _udf(_strict, StringType())
tolerant_tree_of = _udf(_tolerant, StringType())

NODES = StructType([StructField("path", ArrayType(IntegerType())), StructField("parent_path", ArrayType(IntegerType())), StructField("ord", IntegerType()), StructField("type", StringType()), StructField("text", StringType()), StructField("attrs", MapType(StringType(), StringType()))])


def node_rows(nodes: list) -> list[tuple]:
    """(path, parent path, order, type, text, attributes) of all nodes."""
    out, stack = [], [((i,), n) for i, n in reversed(list(enumerate(nodes)))]
    while stack:
        path, n = stack.pop()
        if isinstance(n, str):
            out.append((list(path), list(path[:-1]), len(out), "text", n, {}))
            continue
        own = [c for _, part in child_lists(n) for c in part]
        attrs = {f: str(n[f]) for f in FIXED[n["type"]] if n.get(f) is not None}
        out.append((list(path), list(path[:-1]), len(out), n["type"], None, attrs))
        stack += [((*path, i), c) for i, c in reversed(list(enumerate(own)))]
    return out


def node_table(df: DataFrame, key: str, tree: str) -> DataFrame:
    """One row for each node of the trees (JSON text) of a table."""
    schema = StructType([StructField(key, df.schema[key].dataType), *NODES.fields])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                made = node_rows(json.loads(text)) if text else []
                at += [i] * len(made)
                rows += made
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array([list(x.items()) for x in cols[5]], pa.map_(pa.string(), pa.string()))],
                schema.names,
            )

    return df.select(key, tree).mapInArrow(run, schema)


def divergence(source: DataFrame, drifted: DataFrame, key: str) -> DataFrame:
    """Types whose node counts differ between two node tables, by document."""
    count = lambda df, n: df.where("type <> 'text'").groupBy(key, "type").agg(F.count("*").alias(n))
    both = count(source, "expected").join(count(drifted, "found"), [key, "type"], "full_outer").na.fill(0, ["expected", "found"])
    return both.where("expected <> found")


def batch_size_gate(markup: Column, most: int = 30_000) -> Column:
    """Bodies above this many characters take the batch path."""
    return F.length(markup) > most


APPLIED = "state string, error string, tree string, stripped boolean, texts array<struct<src:string,spans:array<string>>>"


def applied(source: list, reply: str) -> tuple:
    """A translated body by its reply: (state, error, tree, stripped, texts).

    The reply is read forgivingly; an empty or unreadable one fails.  Attributes that
    drifted are put back, time and event marks go where their numbers differ, and the
    texts of images leave the tree, with the image they belong to if the numbers agree.
    """
    try:
        found = from_markup(reply, tolerant=True)
    except ValueError:
        return "failed", "the translated markup could not be read", None, False, []
    if not found:
        return "failed", "the translated body was empty", None, False, []
    tree, _, divergent = reconciled(source, found)
    strip = any(t in ("time", "event") for t in divergent)
    if strip:
        tree = stripped(tree)
    own, other = ([n for n in walk(t) if isinstance(n, dict) and n["type"] == "image"] for t in (source, tree))
    texts = [(a.get("src"), b["text"]) for a, b in zip(own, other) if a.get("text") and b.get("text")] if len(own) == len(other) else []
    for n in other:
        n.pop("text", None)
    return "done", None, json.dumps(tree, ensure_ascii=False), strip, texts


def applied_translations(df: DataFrame, source: str, reply: str) -> DataFrame:
    """df with the columns of APPLIED for a source tree (JSON text) and the reply of a translator; null replies fail."""
    made = StructType.fromDDL(APPLIED)
    schema = StructType([*df.schema.fields, *made.fields])
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("src", pa.string()), ("spans", pa.list_(pa.string()))]))]

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            trees, replies = (batch.column(names.index(c)).to_pylist() for c in (source, reply))
            rows = [applied(json.loads(t or "[]"), r or "") for t, r in zip(trees, replies, strict=True)]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in kinds]
            cols[4] = [[{"src": a, "spans": b} for a, b in x] for x in cols[4]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return df.mapInArrow(run, schema)
