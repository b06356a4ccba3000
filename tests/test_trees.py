"""Markup round trips, repairs and page extraction."""

import random

import pytest

from larkspur.operators import tree as T
from larkspur.sources import html as H


def _inline(rng, depth=2):
    out = []
    for _ in range(rng.randint(1, 3)):
        k = rng.randint(0, 9) if depth else 0
        inner = _inline(rng, depth - 1) if depth else []
        out.append(
            [
                "te & <x> \"q\"",
                {"type": "break"},
                {"type": "strong", "children": inner},
                {"type": "emphasis", "children": inner},
                {"type": "color", "value": "#FF0000", "children": inner},
                {"type": "link", "href": "/a?b=1&c", "external": True, "children": inner},
                {"type": "badge", "text": "New", "variant": "n"},
                {"type": "icon", "src": "i.png"},
                {"type": "time", "datetime": "2024-01-01", "children": inner},
                {"type": "event", "id": "e", "start": "s", "end": "t", "children": inner},
            ][k]
        )
    return T.merged_texts(out)


def _block(rng, depth=2):
    mixed = lambda: [_block(rng, depth - 1) for _ in range(rng.randint(1, 2))] if depth else [{"type": "divider"}]
    k = rng.randint(0, 16)
    return [
        lambda: {"type": "paragraph", "align": "center", "children": _inline(rng)},
        lambda: {"type": "heading", "level": rng.randint(1, 4), "anchor": "x", "children": _inline(rng)},
        lambda: {"type": "button", "href": "/x", "children": _inline(rng)},
        lambda: {"type": "divider"},
        lambda: {"type": "image", "src": "a.png", "alt": 'a"b', "external": True, "href": "/y", "sources": [{"src": "b.png", "minWidth": 3}]},
        lambda: {"type": "image", "src": "a.png", "text": ["one", "two <b>"], "caption": _inline(rng)},
        lambda: {"type": "video", "provider": "youtube", "src": "v", "caption": _inline(rng)},
        lambda: {"type": "embed", "provider": "twitter", "content": "c"},
        lambda: {"type": "infoBox", "variant": "terms", "children": mixed()},
        lambda: {"type": "section", "variant": "report", "title": _inline(rng), "dateline": _inline(rng), "children": mixed()},
        lambda: {"type": "accordion", "summary": _inline(rng), "children": mixed()},
        lambda: {"type": "speechBubble", "icon": "i", "speaker": "s & t", "children": mixed()},
        lambda: {"type": "messageBox", "name": "n", "role": "r", "children": mixed()},
        lambda: {"type": "list", "ordered": rng.random() < 0.5, "variant": "caution", "items": [{"children": _inline(rng)}, {"children": mixed()}]},
        lambda: {"type": "table", "variant": "tp", "headers": [{"header": True, "colSpan": 2, "children": _inline(rng)}], "rows": [[{"children": _inline(rng)}, {"rowSpan": 3, "children": mixed()}]]},
        lambda: {"type": "interview", "title": "t", "writer": "w", "exchanges": [{"question": _inline(rng), "answer": mixed()}]},
        lambda: rng.choice([{"type": "steps", "variant": "numbered", "items": [{"n": 1, "children": mixed()}]}, {"type": "ranking", "items": [{"rank": 2, "count": "9", "title": _inline(rng)}]}]),
    ][k]()


@pytest.mark.parametrize("seed", range(60))
def test_markup_round_trip(seed):
    rng = random.Random(seed)
    blocks = [_block(rng) for _ in range(4)]
    assert T.from_markup(T.to_markup(blocks)) == blocks
    assert T.valid(blocks) and T.to_html(blocks)


def test_strict_and_tolerant():
    with pytest.raises(T.MarkupError):
        T.from_markup("<p>a<blink>b</blink></p>")
    assert T.from_markup("<p>a<blink>b</blink></p>", tolerant=True) == [{"type": "paragraph", "children": ["ab"]}]


def test_strip_and_count():
    tree = [{"type": "paragraph", "children": ["a ", {"type": "event", "id": "1", "start": "s", "children": ["b", {"type": "time", "datetime": "d", "children": ["c"]}]}, " d"]}]
    assert T.tag_counts(tree) == (1, 1)
    assert T.stripped(tree) == [{"type": "paragraph", "children": ["a bc d"]}]
    assert T.preserves_content([{"type": "paragraph", "children": ["a bc d"]}], tree)


def test_reconcile():
    source = [{"type": "image", "src": "a.png", "alt": "x"}, {"type": "paragraph", "children": [{"type": "link", "href": "/1", "children": ["a"]}]}, {"type": "divider"}]
    drifted = [{"type": "image", "src": "b.png"}, {"type": "paragraph", "children": [{"type": "link", "href": "/2", "external": True, "children": ["b"]}]}]
    fixed, repairs, divergent = T.reconciled(source, drifted)
    assert fixed[0] == source[0] and fixed[1]["children"][0] == {"type": "link", "href": "/1", "children": ["b"]}
    assert repairs == 4 and divergent == ["divider"]


def test_page_blocks():
    page = """<body><nav><a href="/x">x</a></nav><div class="newsContent"><div>
      <a id="top"></a><h2>Head</h2>plain <b>bold</b> text<br>next
      <p align="center"><img src="m.png"><br>cap</p><ul><li>a<li>b</ul>
      <table><tr><td>x<tr><td>y</table><div class="lineType1"></div>
      <div class="hukiBox"><p class="huki_name">Bo</p><div class="huki">hey</div></div>
      <iframe src="https://www.youtube.com/embed/1"></iframe><a href="/t" class="btn01">go</a></div></div></body>"""
    got = H.blocks(page)
    assert [b["type"] for b in got] == ["heading", "paragraph", "image", "list", "table", "divider", "speechBubble", "video", "button"]
    assert got[0]["anchor"] == "top" and got[2]["caption"] == ["cap"] and len(got[3]["items"]) == 2
    assert got[4]["variant"] == "layout" and len(got[4]["rows"]) == 2 and got[6]["speaker"] == "Bo"
    assert T.valid(got)


def test_titles_and_links():
    assert H.title("<title> T </title><h1> </h1>") == "T"
    assert H.links("<a href='/a'>x  y</a><a>no</a><a href='/b'></a>") == [(0, "/a", "x y"), (1, "/b", "")]


def test_crawl_order(spark):
    edges = spark.createDataFrame([("a", 0, "b", "B"), ("a", 1, "c", "C"), ("c", 0, "b", "late"), ("b", 0, "d", "D"), ("d", 0, "a", "A")], "src string, pos int, dst string, title string")
    assert [(r["page"], r["title"]) for r in H.crawl_order(edges, "a").orderBy("ord").collect()] == [("a", None), ("b", "B"), ("c", "C"), ("d", "D")]
    assert H.crawl_order(edges, "a", 2).count() == 2
