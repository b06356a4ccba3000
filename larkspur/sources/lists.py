"""List pages, archives, banners and forecast tables to rows: one pass of the DOM for each page, the rest as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import dates as D
from ..functions.dom import Element, parse

# Marks of the pages that this reads.
DATE_CELL = "date"
HEADED = "iconTitle"
BANNER_BOX, BANNER_SLIDE = "topBanner", "slide"
FORECAST_BOX, FORECAST_GRID = "tokoyami-box", "tokoyami-raid"
ROTATIONS = {"bootcamp": 7, "panigarm": 3}
GRIDS = {"raid": 60, "metal": 30}
DAY_GRID = "togabito"
NAVIGATION = ("詳細", "もっと見る")
MONTH_LINK = r"/sc/topics/backnumber/([0-9]{4})/([0-9]{1,2})/"
_ROW_DATE = re.compile(r"\d{4}[-/]\d{2}[-/]\d{2}(?:\s+\d{2}:\d{2})?")
_BANNER_LINK = re.compile(r"link=([^'\")]+)")


def page_rows(pages: DataFrame, key: list[str], html: str, fields: str, reader: Callable[[Element], list[tuple]]) -> DataFrame:
    """(key..., fields...): what reader finds on each page, one row for each tuple; null and empty pages give none."""
    own = StructType.fromDDL(fields)
    schema = StructType([*(StructField(k, pages.schema[k].dataType) for k in key), *own.fields])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(len(key)).to_pylist()):
                made = reader(parse(text)) if text else []
                at += [i] * len(made)
                rows += made
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(own)
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[: len(key)], *(pa.array(c, _kind(f.dataType)) for c, f in zip(cols, own, strict=True))], schema.names)

    return pages.select(*key, html).mapInArrow(run, schema)


def _kind(t: DataType) -> pa.DataType:
    return to_arrow_type(t)


def _up(e: Element, tag: str) -> Element | None:
    while e is not None and e.tag != tag:
        e = e.parent
    return e


def _date_near(link: Element) -> str | None:
    """A date in the date cell beside the link's cell, else in the row."""
    cell, row = _up(link, "td"), _up(link, "tr")
    beside = next((c for c in cell.parent.elements() if c is not cell and c.tag == "td" and c.has_class(DATE_CELL)), None) if cell is not None else None
    for e in (beside, row):
        if e is not None and (m := _ROW_DATE.search(e.text())):
            return m[0]
    return None


def dated_items(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """(key, id, title, date): items of a list page by the ids in their links, with the date beside them.

    The first link of an id decides; one without a title, or to navigate, loses the item.
    """
    wanted = re.compile(pattern)

    def read(page: Element) -> list[tuple]:
        first: dict[str, tuple] = {}
        for a in page.walk():
            if a.tag == "a" and (m := wanted.search(a.get("href") or "")) and m[1] not in first:
                first[m[1]] = (m[1], a.text().strip(), _date_near(a))
        return [(i, t, d, k) for k, (i, t, d) in enumerate(first.values()) if t and t not in NAVIGATION]

    return page_rows(pages, [key], html, "id string, title string, date string, pos int", read)


def headed_items(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """(key, id, raw_title, pos): links in the headings of a listing; links in the bodies between them do not count."""
    wanted = re.compile(pattern)

    def read(page: Element) -> list[tuple]:
        first: dict[str, str] = {}
        for h in page.walk():
            if h.tag == "h2" and h.has_class(HEADED):
                for a in h.walk():
                    if a.tag == "a" and (m := wanted.search(a.get("href") or "")):
                        first.setdefault(m[1], a.text().strip())
        return [(i, t, k) for k, (i, t) in enumerate(first.items()) if t]

    return page_rows(pages, [key], html, "id string, raw_title string, pos int", read)


def archive_sources(links: DataFrame, key: str, base: str) -> DataFrame:
    """(key, label, url, year, month, ord): the current page, then each linked month once, newest first."""
    months = links.select(key, F.regexp_extract("href", MONTH_LINK, 1).try_cast("int").alias("year"), F.regexp_extract("href", MONTH_LINK, 2).try_cast("int").alias("month")).where("year is not null").distinct()
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("year", "month"))))
    rows = months.groupBy(key).agg(newest.alias("_m")).select(key, F.posexplode("_m").alias("_n", "_s"))
    slashed = F.concat_ws("/", F.col("_s.year"), F.col("_s.month"))
    archived = rows.select(key, slashed.alias("label"), F.concat(F.lit(base + "/backnumber/"), slashed, F.lit("/")).alias("url"), F.col("_s.year").alias("year"), F.col("_s.month").alias("month"), (F.col("_n") + 1).alias("ord"))
    none = F.lit(None).cast("int")
    current = links.select(key).distinct().select(key, F.lit("current").alias("label"), F.lit(base + "/").alias("url"), none.alias("year"), none.alias("month"), F.lit(0).alias("ord"))
    return current.unionByName(archived)


def rotation_banners(pages: DataFrame, key: str, html: str, topic: str = r"/sc/topics/detail/([a-f0-9]{32})/") -> DataFrame:
    """(key, src, link, topic_id, alt, ord, published): slides of a banner box, each image once, in their order."""

    def read(page: Element) -> list[tuple]:
        box = page.first(lambda e: e.get("id") == BANNER_BOX)
        out: dict[str, tuple] = {}
        for slide in box.walk() if box is not None else ():
            if slide.tag != "li" or not slide.has_class(BANNER_SLIDE):
                continue
            img, a = slide.first(lambda e: e.tag == "img"), slide.first(lambda e: e.tag == "a")
            src = (img.get("src") or "").strip() if img is not None else ""
            if src and src not in out:
                m = _BANNER_LINK.search((a.get("href") or "") if a is not None else "")
                out[src] = (src, unquote(m[1]) if m else None, (img.get("alt") or "").strip(), len(out))
        return list(out.values())

    rows = page_rows(pages, [key], html, "src string, link string, alt string, ord int", read)
    day = F.regexp_extract("src", "banner_rotation_([0-9]{8})_", 1)
    return rows.withColumn("topic_id", F.nullif(F.regexp_extract("link", topic, 1), F.lit(""))).withColumn("published", F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")).cast("date"))


def forecast(pages: DataFrame, key: str, html: str, today: Column) -> DataFrame:
    """(key, content, kind, date, start_minute, minutes, icon, name, guide): the cells of a page's forecast tables.

    rotation: bosses by date, changing every few days; grid: icons by date and time,
    where the hours before six belong to the next date; day: icons of whole days.
    A header's month and day fall in the year that lies nearest to `today`.
    """

    def after(heading: Element) -> list[Element]:
        own = heading.parent.elements()
        return [e for e in own[own.index(heading) + 1 :] if e.has_class(FORECAST_BOX)]

    def cells(table: Element | None):
        rows = [e for e in table.walk() if e.tag == "tr"] if table is not None else []
        if len(rows) < 2:
            return [], []
        heads = [re.search(r"(\d{1,2})/(\d{1,2})", e.text()) for e in rows[0].walk() if e.tag == "th"][1:]
        return [(int(m[1]), int(m[2])) if m else None for m in heads], [[e for e in r.walk() if e.tag == "td"] for r in rows[1:]]

    def icon(td: Element) -> str | None:
        img = td.first(lambda e: e.tag == "img")
        return (img.get("src") or "").split("?")[0] or None if img is not None else None

    def read(page: Element) -> list[tuple]:
        out = []
        named = {e.get("id"): e for e in reversed(list(page.walk())) if e.get("id")}
        for content, days in ROTATIONS.items():
            if (heading := named.get(content)) is None:
                continue
            boxes = after(heading)
            heads, rows = cells(boxes[0].first(lambda e: e.tag == "table") if boxes else None)
            link = heading.first(lambda e: e.tag == "a" and "/sc/public/playguide/" in (e.get("href") or ""))
            guide = re.search(r"/playguide/([A-Za-z0-9_]+)", link.get("href")) if link is not None else None
            for head, td in zip(heads, rows[0] if rows else ()):
                name = td.first(lambda e: e.tag == "div")
                if head and name is not None and name.text().strip():
                    out.append((content, "rotation", *head, 360, days * 1440, (icon(td) or "").split("/")[-1], name.text().strip(), guide[1] if guide else None))
        for content, minutes in GRIDS.items():
            if (heading := named.get(content)) is None:
                continue
            tables = [t for b in after(heading) for t in b.walk() if t.tag == "table" and t.has_class(FORECAST_GRID)]
            heads, rows = cells(tables[0] if tables else None)
            for tds in rows:
                if tds and (m := re.search(r"(\d{1,2}):(\d{2})", tds[0].text())):
                    out += [(content, "grid", *head, int(m[1]) * 60 + int(m[2]), minutes, icon(td), None, None) for head, td in zip(heads, tds[1:]) if head and icon(td)]
        if (heading := named.get(DAY_GRID)) is not None and (boxes := after(heading)):
            heads, rows = cells(boxes[0].first(lambda e: e.tag == "table"))
            out += [("abyss", "day", *head, 0, 1440, icon(td), None, None) for tds in rows for head, td in zip(heads, tds) if head and icon(td)]
        return out

    rows = page_rows(pages, [key], html, "content string, kind string, month int, day int, start_minute int, minutes int, icon string, name string, guide string", read)
    date = D.inferred_date(F.col("month"), F.col("day"), today)
    rolled = F.when(F.col("kind") == "grid", D.game_date(date, F.floor(F.col("start_minute") / 60))).otherwise(date)
    return rows.withColumn("date", rolled).where("date is not null").drop("month", "day")
