"""Pages to rows: titles, links, lists, and block trees by ordered rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.dom import Element, parse
from ..operators.tree import is_inline, merged_texts

# Class names that mark each kind of block on the pages this reads.
CLASSES = {
    "section": r"(?<!img_)(?<!tit_)newspaper(?!_[hf])",
    "terms": r"box_terms(?!_set)",
    "infoBox": r"brownroundBox|box01|box_quest(?!_set)|box_terms(?!_set)|box_cork(?!_set)|box_mi|box_ss",
    "accordion": r"(?<!btn_)ad_menu",
    "interview": r"box_interview",
    "speechBubble": r"hukiBox",
    "messageBox": r"msg030802_msgBox|inbox",
    "ranking": r"rankbox|ranking_area01|ranking_area02",
    "steps": r"step1|step2|step3|step4|step5|howto",
    "cautionList": r"tp_caution|tp_list",
    "heading": r"title01|title02|title03|title04|title_icon01|title_icon02|iconTitle|title_quest",
    "button": r"btn01|btn_square|btn_vt2013|btn_estore|btn_reservation",
    "figure": r"img_newspaper|newsImage",
    "divider": r"lineType1",
    "embed": r"twitter-tweet|twitter-timeline|twitter-.*-button|hashtag",
}
BOX_VARIANTS = (("box_quest", "quest"), ("box_terms", "terms"), ("box_cork", "cork"), ("box01", "statistics"), ("box_mi", "mini"), ("box_ss", "screenshot"))
ROOTS = (("newsContent", True), ("newsContent", False), ("cttBox", False))
ICONS = r"\bico_|img_2nd|img_3rd|img_smt"

INLINE = {"a", "b", "strong", "em", "i", "u", "s", "small", "sup", "sub", "span", "font", "br", "mark", "ins", "del", "big", "tt", "code"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "ul", "ol", "table", "section", "article", "center", "blockquote", "dl"}
SKIPPED = {"script", "style", "link", "meta", "br", "hr", "nav", "noscript", "head"}
_NAMED = {"red": "#FF0000", "blue": "#0000FF", "green": "#008000"}


def _marked(e: Element, kind: str) -> bool:
    return bool(re.search(CLASSES[kind], e.classes))


def _image(e: Element) -> bool:
    return e.tag == "img" and not re.search(ICONS, (e.get("src") or "") + " " + e.classes)


def _video(e: Element) -> bool:
    return e.tag == "iframe" and bool(re.search(r"youtube|youtu\.be", e.get("src") or ""))


def _any_class(e: Element, *names: str) -> Element | None:
    return e.first(lambda x: any(x.has_class(n) for n in names))


def _meaning(nodes: list) -> bool:
    return any(n.strip() != "" if isinstance(n, str) else n["type"] != "break" for n in nodes)


def _trimmed(nodes: list) -> list:
    while nodes and isinstance(nodes[0], dict) and nodes[0]["type"] == "break":
        nodes = nodes[1:]
    while nodes and isinstance(nodes[-1], dict) and nodes[-1]["type"] == "break":
        nodes = nodes[:-1]
    return nodes


class Reader:
    """One page: rules are tried in order for each element, the first that fits and gives a block wins."""

    def __init__(self, base: str = "", own_host: str = ""):
        self.base, self.own_host = base, own_host
        self.used: set[int] = set()
        self.rules: tuple[tuple[str, Callable[[Element], bool], Callable], ...] = (
            ("section", lambda e: _marked(e, "section"), self.section),
            ("toc", lambda e: _marked(e, "terms") and sum((a.get("href") or "").startswith("#") for a in e.walk() if a.tag == "a") >= 2, self.toc),
            ("infoBox", lambda e: _marked(e, "infoBox"), self.info_box),
            ("accordion", lambda e: _marked(e, "accordion"), self.accordion),
            ("interview", lambda e: _marked(e, "interview"), self.interview),
            ("speechBubble", lambda e: _marked(e, "speechBubble"), self.speech),
            ("messageBox", lambda e: _marked(e, "messageBox"), self.message),
            ("ranking", lambda e: _marked(e, "ranking"), self.ranking),
            ("steps", lambda e: _marked(e, "steps"), self.steps),
            ("table", lambda e: e.tag == "table", self.table),
            ("cautionList", lambda e: _marked(e, "cautionList"), self.caution),
            ("list", lambda e: e.tag in ("ul", "ol"), self.list),
            ("heading", lambda e: e.tag in ("h1", "h2", "h3", "h4") or _marked(e, "heading"), self.heading),
            ("button", lambda e: _marked(e, "button"), self.button),
            ("captionedMedia", lambda e: self._captioned(e) is not None, self.captioned),
            ("linkedImage", lambda e: e.tag == "a" and e.first(_image) is not None, self.linked_images),
            ("divider", lambda e: _marked(e, "divider"), lambda e: {"type": "divider"}),
            ("video", _video, lambda e: {"type": "video", "provider": "youtube", "src": e.get("src")}),
            ("embed", lambda e: _marked(e, "embed"), self.embed),
            ("image", lambda e: _image(e) or _marked(e, "figure"), self.image),
        )

    # inline content

    def url(self, href: str | None) -> str:
        href = href or ""
        return href if href.startswith("#") or not self.base else urljoin(self.base, href)

    def external(self, href: str) -> bool:
        return bool(re.match(r"https?://", href)) and not (self.own_host and self.own_host in href)

    def inline(self, children: list) -> list:
        out = []
        for c in children:
            if isinstance(c, str):
                out.append(re.sub(r"[ \t\r\n\f\x0b]+", " ", c))
            elif c.tag == "br":
                out.append({"type": "break"})
            elif c.tag in ("script", "style"):
                continue
            elif c.tag == "img":
                if c.get("src"):
                    out.append({"type": "icon", "src": self.url(c.get("src"))} | ({"alt": c.get("alt")} if c.get("alt") else {}))
            elif m := re.search(r"\bico_(\w+)", c.classes):
                out.append({"type": "badge", "variant": m[1], "text": c.text().strip()})
            else:
                inner = self.inline(c.children)
                if not inner:
                    continue
                colour = c.get("color") or (re.search(r"(?<![-\w])color\s*:\s*([^;]+)", c.get("style") or "") or [None, None])[1]
                colour = _NAMED.get((colour or "").strip().lower(), (colour or "").strip().upper())
                if re.fullmatch(r"#(?:[0-9A-F]{3}|[0-9A-F]{6})", colour or ""):
                    inner = [{"type": "color", "value": colour, "children": inner}]
                if c.tag in ("em", "i"):
                    inner = [{"type": "emphasis", "children": inner}]
                if c.tag in ("b", "strong") or re.search(r"\b(?:bold_red|txt_bold)\b", c.classes):
                    inner = [{"type": "strong", "children": inner}]
                if c.tag == "a" and c.get("href"):
                    href = self.url(c.get("href"))
                    inner = [{"type": "link", "href": href} | ({"external": True} if self.external(href) else {}) | {"children": inner}]
                out += inner
        out = merged_texts(out)
        if out and isinstance(out[0], str):
            out[0] = out[0].lstrip(" 　")
        if out and isinstance(out[-1], str):
            out[-1] = out[-1].rstrip(" 　")
        return [n for n in out if n != ""]

    # blocks

    def flow(self, e: Element) -> list:
        """Blocks of a container; runs of inline content become paragraphs, and bare anchors go to the next heading."""
        out: list = []
        run: list = []
        anchor = None

        def flush():
            nodes = _trimmed(self.inline(run))
            run.clear()
            if _meaning(nodes):
                out.append({"type": "paragraph", "children": nodes})

        for c in e.children:
            if isinstance(c, str):
                run.append(c)
                continue
            if id(c) in self.used:
                continue
            if c.tag == "a" and (c.get("id") or c.get("name")) and not c.text().strip() and not c.first(_image):
                anchor = c.get("id") or c.get("name")
                continue
            block = None
            for _, fits, build in self.rules:
                if fits(c):
                    block = build(c)
                    break
            if block is not None:
                flush()
                blocks = block if isinstance(block, list) else [block]
                if anchor and blocks and blocks[0]["type"] == "heading" and "anchor" not in blocks[0]:
                    blocks[0]["anchor"], anchor = anchor, None
                out += blocks
            elif id(c) in self.used:
                continue
            elif c.tag == "br" or c.tag in INLINE and not c.first(lambda x: x.tag in BLOCKS or _image(x) or _video(x)):
                run.append(c)
            elif c.tag in SKIPPED or not (c.text().strip() or c.first(lambda x: x.tag in ("img", "iframe"))):
                continue
            elif c.first(lambda x: x.tag in BLOCKS or _image(x) or _video(x) or any(fits(x) for _, fits, _ in self.rules)):
                flush()
                out += self.flow(c)
            else:
                flush()
                nodes = _trimmed(self.inline(c.children))
                if _meaning(nodes):
                    align = self.align(c)
                    out.append({"type": "paragraph"} | ({"align": align} if align != "left" else {}) | {"children": nodes})
        flush()
        return out

    @staticmethod
    def align(e: Element) -> str:
        style = (e.get("style") or "").lower()
        for side in ("center", "right"):
            if (e.get("align") or "").lower() == side or re.search(rf"text-align\s*:\s*{side}", style) or side == "center" and "txt_center" in e.classes:
                return side
        return "left"

    def content(self, e: Element) -> list:
        """Blocks where the element holds any, else inline content."""
        if e.first(lambda x: x.tag in BLOCKS or _image(x)):
            return self.flow(e)
        return _trimmed(self.inline(e.children))

    def heading(self, e):
        level = 2
        for n in (1, 3, 4):
            if e.tag == f"h{n}" or f"title0{n}" in e.classes:
                level = n
                break
        children = self.inline(e.children)
        variant = "icon" if re.search("title_icon|iconTitle", e.classes) else "quest" if "title_quest" in e.classes else None
        anchor = e.get("id") or e.get("name")
        return {"type": "heading", "level": level} | ({"variant": variant} if variant else {}) | ({"anchor": anchor} if anchor else {}) | {"children": children} if children else None

    def button(self, e):
        link = e if e.tag == "a" else next((c for c in e.elements() if c.tag == "a"), e)
        href, children = self.url(link.get("href")), self.inline(link.children)
        variant = next((v for v in ("square", "vt2013", "estore", "reservation") if f"btn_{v}" in e.classes), None)
        return {"type": "button", "href": href} | ({"variant": variant} if variant else {}) | {"children": children} if children or href else None

    def image_node(self, img: Element, within: Element | None = None):
        if not img.get("src"):
            return None
        c = img.classes + " " + (within.classes if within is not None else "")
        variant = "newspaper" if re.search(CLASSES["figure"], c) else next((v for v in ("2nd", "3rd", "smt", "3ds") if f"img_{v}" in c), None)
        return {"type": "image", "src": self.url(img.get("src"))} | ({"alt": img.get("alt")} if img.get("alt") else {}) | ({"variant": variant} if variant else {})

    def image(self, e):
        img = e if e.tag == "img" else e.first(lambda x: x.tag == "img")
        return self.image_node(img, e) if img is not None else None

    def linked_images(self, e):
        href = self.url(e.get("href"))
        out = [self.image_node(x) for x in e.walk() if _image(x)]
        extra = ({"href": href} if href else {}) | ({"external": True} if self.external(href) else {})
        return [x | extra for x in out if x] or None

    def _captioned(self, e: Element):
        """(medium, caption, sibling with the caption) of a centred or figure box with one medium and nothing before it."""
        if not (e.tag == "center" or self.align(e) == "center" or _marked(e, "figure")):
            return None
        media = [x for x in e.walk() if _image(x) or _video(x)]
        if len(media) != 1:
            return None
        top = media[0]
        while top.parent is not e:
            if top.parent is None:
                return None
            top = top.parent
        at = next(i for i, c in enumerate(e.children) if c is top)
        if any(c.strip() if isinstance(c, str) else c.text().strip() for c in e.children[:at]):
            return None
        after = e.children[at + 1 :]
        if any(isinstance(c, Element) and c.tag in BLOCKS for c in after):
            return None
        caption = _trimmed(self.inline(after))
        if _meaning(caption):
            return media[0], caption, None
        around = e.parent.children if e.parent is not None else []
        here = next((i for i, c in enumerate(around) if c is e), len(around))
        for c in around[here + 1 :]:
            if isinstance(c, str) and not c.strip() or isinstance(c, Element) and c.tag == "br":
                continue
            if isinstance(c, Element) and c.tag == "center" and not c.first(lambda x: x.tag in BLOCKS or x.tag in ("img", "iframe")):
                caption = _trimmed(self.inline(c.children))
                return (media[0], caption, c) if _meaning(caption) else None
            return None
        return None

    def captioned(self, e):
        medium, caption, sibling = self._captioned(e)
        if _video(medium):
            node = {"type": "video", "provider": "youtube", "src": medium.get("src")}
        else:
            node = self.image_node(medium, e)
            if node is None:
                return None
            x = medium
            while x is not e and x.tag != "a":
                x = x.parent
            if x.tag == "a" and x is not e and x.get("href"):
                href = self.url(x.get("href"))
                node |= {"href": href} | ({"external": True} if self.external(href) else {})
        if sibling is not None:
            self.used.add(id(sibling))
        return node | {"caption": caption}

    def embed(self, e):
        c = e.classes
        variant = "timeline" if "twitter-timeline" in c else "button" if "button" in c else "hashtag" if "hashtag" in c else "tweet"
        content = e.text().strip() or e.get("href")
        return {"type": "embed", "provider": "twitter", "variant": variant} | ({"content": content} if content else {})

    def list(self, e):
        items = [{"children": x} for x in (self.content(li) for li in e.elements() if li.tag == "li") if x]
        return {"type": "list", "ordered": e.tag == "ol", "items": items} if items else None

    def caution(self, e):
        lis = [x for x in e.walk() if x.tag == "li"]
        groups = [self.content(x) for x in lis] if lis else [_trimmed(self.inline(g)) for g in _by_break(e.children)]
        items = [{"children": g} for g in groups if _meaning(g)]
        variant = {"variant": "caution"} if "tp_caution" in e.classes else {}
        return {"type": "list", "ordered": False} | variant | {"items": items} if items else None

    def table(self, e):
        def cell(c):
            spans = {f: int(c.get(a)) for f, a in (("colSpan", "colspan"), ("rowSpan", "rowspan")) if (c.get(a) or "").isdigit() and int(c.get(a)) > 1}
            return ({"header": True} if c.tag == "th" else {}) | spans | {"children": self.content(c)}

        def cells(tr):
            return [cell(c) for c in tr.elements() if c.tag in ("td", "th")]

        head = e.first(lambda x: x.tag == "thead")
        in_head = set(map(id, head.walk())) if head else set()
        first = head.first(lambda x: x.tag == "tr") if head else None
        headers = cells(first) if first is not None else []
        rows = [r for r in (cells(tr) for tr in e.walk() if tr.tag == "tr" and id(tr) not in in_head) if r]
        if not rows and not headers:
            return None
        variant = "contents" if "contentsTable1" in e.classes else "tp" if "tp_table" in e.classes else None
        if variant is None and not headers and all(len(r) == 1 and "colSpan" not in r[0] and "rowSpan" not in r[0] for r in rows):
            variant = "layout"
        return {"type": "table"} | ({"variant": variant} if variant else {}) | ({"headers": headers} if headers else {}) | {"rows": rows}

    def toc(self, e):
        table = e.first(lambda x: x.tag == "table")
        groups = [next((c.children for c in tr.elements() if c.tag in ("td", "th")), []) for tr in table.walk() if tr.tag == "tr"] if table else _by_break((e.by_class("box_terms_set2") or e).children)
        entries = [x for x in (_trimmed(self.inline(g)) for g in groups) if _meaning(x)]
        linked = lambda x: any(isinstance(n, dict) and n["type"] == "link" and n["href"].startswith("#") for n in x)
        title = next((x for x in entries if not linked(x)), None)
        items = [{"children": x} for x in entries if x is not title]
        if len(items) < 2:
            return self.info_box(e)
        return {"type": "infoBox", "variant": "toc", "children": ([{"type": "paragraph", "children": title}] if title else []) + [{"type": "list", "ordered": False, "items": items}]}

    def info_box(self, e):
        variant = next((v for c, v in BOX_VARIANTS if c in e.classes), "highlight")
        inner = _any_class(e, "box_quest_set2", "box_terms_set2", "box_cork_set2", "brb_f") or _any_class(e, "box_quest_set1", "box_terms_set1", "box_cork_set1", "brb_h") or e
        return {"type": "infoBox", "variant": variant, "children": self.flow(inner)}

    def _lifted(self, e, *names):
        x = _any_class(e, *names)
        if x is not None:
            self.used.add(id(x))
        return x

    def section(self, e):
        title, date = self._lifted(e, "tit_newspaper", "tit_newspaper_report"), self._lifted(e, "news_date")
        inner = e.by_class("newspaper_f") or e.by_class("newspaper_h") or e
        return {"type": "section", "variant": "report" if "tit_newspaper_report" in e.classes else "newspaper"} | ({"title": self.inline(title.children)} if title else {}) | ({"dateline": self.inline(date.children)} if date else {}) | {"children": self.flow(inner)}

    def accordion(self, e):
        button, body = self._lifted(e, "btn_ad_menu"), e.by_class("wrap_table")
        summary, children = self.inline(button.children) if button else [], self.flow(body) if body else []
        return {"type": "accordion", "summary": summary, "children": children} if summary or children else None

    def speech(self, e):
        speaker = self._lifted(e, "huki_name", "speaker")
        icon = (e.by_class("huki_icon") or e).first(lambda x: x.tag == "img")
        if icon is not None:
            self.used.add(id(icon))
        inner = e.by_class("huki_f") or e.by_class("huki_h") or e.by_class("huki") or e
        return {"type": "speechBubble"} | ({"speaker": speaker.text().strip()} if speaker else {}) | ({"icon": self.url(icon.get("src"))} if icon is not None and icon.get("src") else {}) | {"children": self.flow(inner)}

    def message(self, e):
        name, role = self._lifted(e, "msg030802_name", "name"), self._lifted(e, "msg030802_job", "job")
        inner = _any_class(e, "msg030802_content", "content") or e
        return {"type": "messageBox"} | ({"name": name.text().strip()} if name else {}) | ({"role": role.text().strip()} if role else {}) | {"children": self.flow(inner)}

    def interview(self, e):
        title, writer = e.by_class("tit_interview"), e.by_class("txt_itv_writer")
        exchanges: list[dict] = []
        for part in e.walk():
            if part.has_class("tit_q"):
                exchanges.append({"question": self.inline(part.children), "answer": []})
            elif exchanges and (part.has_class("tit_a") or part.has_class("txt_itv_main")):
                exchanges[-1]["answer"] += self.flow(part)
        exchanges = [x for x in exchanges if x["question"]]
        return {"type": "interview"} | ({"title": title.text().strip()} if title else {}) | ({"writer": writer.text().strip()} if writer else {}) | {"exchanges": exchanges} if exchanges else None

    def ranking(self, e):
        items = []
        for i, t in enumerate(x for x in e.walk() if x.has_class("mst") or x.has_class("title")):
            rank, count = _any_class(t.parent, "rank", "num_count"), t.parent.by_class("count")
            digits = re.match(r"\s*(\d+)", rank.text()) if rank else None
            title = self.inline(t.children)
            if title:
                items.append({"rank": int(digits[1]) if digits and int(digits[1]) else i + 1} | ({"count": count.text().strip()} if count and count.text().strip() else {}) | {"title": title})
        if not items and self.inline(e.children):
            items = [{"rank": 1, "title": self.inline(e.children)}]
        variant = {"variant": "area"} if "ranking_area" in e.classes else {}
        return {"type": "ranking"} | variant | {"items": items} if items else None

    def steps(self, e):
        parts = [x for x in (e.parent or e).walk() if any(x.has_class(f"step{n}") for n in range(1, 6))] or [e]
        items = []
        for s in parts:
            n = re.search(r"step([1-5])", s.classes)
            items.append(({"n": int(n[1])} if n else {}) | {"children": [b for b in self.flow(s) if not is_inline(b)]})
            self.used.add(id(s))
        return {"type": "steps"} | ({"variant": "howto"} if "howto" in e.classes else {"variant": "numbered"}) | {"items": items}


def _by_break(children: list) -> list[list]:
    out: list[list] = [[]]
    for c in children:
        if isinstance(c, Element) and c.tag == "br":
            out.append([])
        else:
            out[-1].append(c)
    return out


def blocks(html: str, base: str = "", own_host: str = "") -> list:
    """The block tree of a page's content root."""
    page = parse(html)
    root = None
    for name, inner in ROOTS:
        found = page.by_class(name)
        if found is not None:
            root = next((c for c in found.elements() if c.tag == "div"), None) if inner else found
            if root is not None:
                break
    root = root or page.first(lambda e: e.get("id") == "contentArea") or page.first(lambda e: e.tag in ("article", "main")) or page.first(lambda e: e.tag == "body") or page
    return Reader(base, own_host).flow(root)


def title(html: str) -> str | None:
    """The first of h1, title and og:title that is not empty."""
    page = parse(html)
    h1, head = page.first(lambda e: e.tag == "h1"), page.first(lambda e: e.tag == "title")
    og = page.first(lambda e: e.tag == "meta" and e.get("property") == "og:title")
    return next((t for t in ((h1.text().strip() if h1 else ""), (head.text().strip() if head else ""), (og.get("content") or "" if og else "")) if t), None)


def links(html: str) -> list[tuple[int, str, str]]:
    """(position, href, text) of all links; texts are trimmed."""
    found = [(e.get("href"), re.sub(r"\s+", " ", e.text()).strip()) for e in parse(html).walk() if e.tag == "a" and e.get("href")]
    return [(i, h, t) for i, (h, t) in enumerate(found)]


@F.pandas_udf(StringType())
def page_title(s: pd.Series) -> pd.Series:
    return s.map(title, na_action="ignore")


@F.pandas_udf(StringType())
def page_tree(s: pd.Series) -> pd.Series:
    """The block tree as JSON text."""
    return s.map(lambda h: json.dumps(blocks(h), ensure_ascii=False), na_action="ignore")


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href, text) of each page's links."""
    schema = StructType([StructField(key, pages.schema[key].dataType), *_LINKS.fields])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, h in enumerate(batch.column(1).to_pylist()):
                made = links(h) if h else []
                at += [i] * len(made)
                rows += made
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], schema.names)

    return pages.select(key, html).mapInArrow(run, schema)


from pyspark.sql.types import IntegerType  # noqa: E402

_LINKS = StructType([StructField("pos", IntegerType()), StructField("href", StringType()), StructField("text", StringType())])


def listed_items(links: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, id, title, pos): the first link of each id on a page; ids whose first link has no title are lost.

    Ids are found by the pattern's group; the first place decides before empty titles go.
    """
    rows = links.withColumn("id", F.nullif(F.regexp_extract("href", pattern, 1), F.lit(""))).where("id is not null")
    first = rows.groupBy(key, "id").agg(F.min_by("text", "pos").alias("title"), F.min("pos").alias("pos"))
    return first.where("title <> ''")


def page_count(hrefs: DataFrame, key: str, pattern: str, current: str | None = None) -> DataFrame:
    """Pages of a listing: the greatest page suffix of its links plus one, or the current marker."""
    n = F.coalesce(F.max(F.regexp_extract("href", pattern, 1).try_cast("int") + 1), F.lit(1))
    return hrefs.groupBy(key).agg((F.greatest(n, F.max(current)) if current else n).alias("pages"))


def list_page_url(base, page):
    """Pages count from 1 in calls and from 0 in addresses."""
    return F.when(page > 1, F.concat(base, F.lit("/"), (page - 1).cast("string"))).otherwise(base)


def crawl_order(edges: DataFrame, start: str, most: int = 250) -> DataFrame:
    """(page, title, ord): pages in breadth-first order from a start, at most `most` of them.

    edges: (src, pos, dst, title).  The crawl itself is bounded by `most` pages: each
    level is one join and one sum, of which only the pages that are still wanted come
    to the driver.
    """
    spark = edges.sparkSession
    seen, order, level = {start: None}, [start], [start]
    while level and len(order) < most:
        here = spark.createDataFrame([(p, i) for i, p in enumerate(level)], "src string, rank int")  # `most` rows at most
        first = edges.join(F.broadcast(here), "src").where(~F.col("dst").isin(list(seen))).groupBy("dst").agg(F.min(F.struct("rank", "pos", "title")).alias("f"))
        level = []
        for r in first.orderBy("f.rank", "f.pos").limit(most - len(order)).collect():
            seen[r["dst"]] = r["f"]["title"]
            order.append(r["dst"])
            level.append(r["dst"])
    return spark.createDataFrame([(p, seen[p], i) for i, p in enumerate(order)], "page string, title string, ord int")
