"""List pages, archives, banners and forecasts, read from pages that are written from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import lists as H
from ..sources.tables import load
from .catalog import query


def _joined(rows, key, order, html):
    """One page for each key: the html of its rows in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), html.alias("h"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["h"]), "").alias("html"))


@query("""
select custkey, id, title, date, pos from (
  select o_custkey as custkey, 'n' || o_orderkey as id, case o_orderkey % 7 when 0 then 'もっと見る' when 1 then '' else o_orderpriority end as title,
    case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y/%m/%d') || ' 10:30' end as date,
    (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as pos from orders) where title not in ('', 'もっと見る')""")
def dated_items(spark, d):
    """Items of list pages with the date in the next cell, else in the row; navigation links lose their item."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    link = F.concat(F.lit('<a href="/sc/news/detail/n'), k, F.lit('/">'), F.when(k % 7 == 0, "もっと見る").when(k % 7 == 1, "").otherwise(F.col("o_orderpriority")), F.lit("</a>"))
    beside = F.concat(F.lit('<tr><td class="news">'), link, F.lit('</td><td class="date"><div> '), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</div></td></tr>"))
    inside = F.concat(F.lit("<tr><td>"), link, F.lit("</td><td>"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(""), F.lit(" 10:30</td></tr>"))
    again = F.concat(F.lit('<tr><td><a href="/sc/news/detail/n'), k, F.lit('">again</a></td></tr>'))
    pages = _joined(o, "o_custkey", "o_orderkey", F.concat(F.when(k % 2 == 0, beside).otherwise(inside), again))
    pages = pages.select(F.col("o_custkey").alias("custkey"), F.concat(F.lit("<table>"), "html", F.lit("</table>")).alias("html"))
    return H.dated_items(pages, "custkey", "html", "/sc/news/detail/([^/]+)/?")


@query("""
select o_custkey as custkey, md5(o_orderkey::varchar) as id, o_orderpriority || '(2024/3/' || o_orderkey % 28 || ')' as raw_title, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as pos from orders""")
def headed_items(spark, d):
    """Only links in headings are entries; links in the previews between them are not."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    detail = lambda x: F.concat(F.lit('<a href="/sc/topics/detail/'), F.md5(x.cast("string").cast("binary")), F.lit('/">'))
    html = F.concat(F.lit('<h2 class="x iconTitle">'), detail(k), F.lit(" "), F.col("o_orderpriority"), F.lit("(2024/3/"), k % 28, F.lit(")</a></h2><p>"), detail(k + 1_000_000), F.lit("see</a></p>"))
    pages = _joined(o, "o_custkey", "o_orderkey", html).withColumnRenamed("o_custkey", "custkey")
    return H.headed_items(pages, "custkey", "html", "/sc/topics/detail/([a-f0-9]{32})/")


@query("""
with m as (select distinct o_custkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month from orders)
select o_custkey, 'current' as label, 'http://x/' as url, null::int as year, null::int as month, 0 as ord from (select distinct o_custkey from orders)
union all select o_custkey, year || '/' || month, 'http://x/backnumber/' || year || '/' || month || '/', year, month, (row_number() over (partition by o_custkey order by year desc, month desc))::int from m""")
def archive_sources(spark, d):
    """The current page and every linked month, newest first."""
    href = F.concat(F.lit("http://x/sc/topics/backnumber/"), F.year("o_orderdate"), F.lit("/"), F.month("o_orderdate"), F.lit("/#top"))
    return H.archive_sources(load(spark, d, "orders").select("o_custkey", href.alias("href")), "o_custkey", "http://x")


@query("""
with s as (select o_custkey as page, o_orderkey, 'http://img/banner_rotation_' || strftime(o_orderdate, '%Y%m%d') || '_001.jpg' as src from orders),
f as (select *, row_number() over (partition by page, src order by o_orderkey) as n from s)
select page, src, case when o_orderkey % 4 <> 0 then 'http://x/sc/topics/detail/' || md5(o_orderkey::varchar) || '/?a=b' end as link, case when o_orderkey % 4 <> 0 then md5(o_orderkey::varchar) end as topic_id,
  'b' || o_orderkey as alt, (row_number() over (partition by page order by o_orderkey) - 1)::int as ord, strptime(src[28:35], '%Y%m%d')::date as published from f where n = 1""")
def rotation_banners(spark, d):
    """Slides of banner boxes: each image once, with its decoded link and the date of its name."""
    k = F.col("o_orderkey")
    action = F.when(k % 4 != 0, F.concat(F.lit("javascript:ctrLinkAction('link=http%3A%2F%2Fx%2Fsc%2Ftopics%2Fdetail%2F"), F.md5(k.cast("string").cast("binary")), F.lit("%2F%3Fa%3Db')"))).otherwise("#")
    src = F.concat(F.lit("http://img/banner_rotation_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_001.jpg"))
    html = F.concat(F.lit('<li class="slide"><a href="'), action, F.lit('"><img src=" '), src, F.lit('" alt=" b'), k, F.lit(' "></a></li>'))
    pages = _joined(load(spark, d, "orders"), "o_custkey", "o_orderkey", html)
    pages = pages.select(F.col("o_custkey").alias("page"), F.concat(F.lit('<ul><li class="slide"><img src="no"></li></ul><div id="topBanner"><ul>'), "html", F.lit("</ul></div>")).alias("html"))
    return H.rotation_banners(pages, "page", "html")


@query("""
with s as (select s_suppkey as page, s_name, date '2023-12-20' + (s_suppkey % 120)::int as d0 from supplier),
r as (select page, 'panigarm' as content, 'rotation' as kind, 360 as start_minute, 4320 as minutes, '4.png' as icon, s_name as name, 'guide_' || page as guide, d0 as date from s
 union all select page, 'panigarm', 'rotation', 360, 4320, '4.png', s_name || ' x', 'guide_' || page, d0 + 2 from s
 union all select page, 'raid', 'grid', 360, 60, 'http://i/a.png', null, null, d0 from s
 union all select page, 'raid', 'grid', 360, 60, 'http://i/c.png', null, null, d0 + 2 from s
 union all select page, 'raid', 'grid', 330, 60, 'http://i/b.png', null, null, d0 + 2 from s
 union all select page, 'abyss', 'day', 0, 1440, 'http://i/' || n || '.png', null, null, d0 + n from s, (values (0), (1), (2)) v(n))
select page, content, kind, start_minute::int as start_minute, minutes::int as minutes, icon, name, guide, date::date as date from r""")
def forecast(spark, d):
    """Rotations, icon grids and day grids of a forecast page, with years inferred from today."""
    s = load(spark, d, "supplier").withColumn("d0", F.date_add(F.lit("2023-12-20").cast("date"), (F.col("s_suppkey") % 120).cast("int")))
    heads = F.concat(F.lit("<tr><th>date</th>"), *[F.concat(F.lit("<th>"), F.date_format(F.date_add("d0", n), "MM/dd"), F.lit("(土)</th>")) for n in range(3)], F.lit("</tr>"))
    table = lambda name, *rows: F.concat(F.lit(f'<div class="tokoyami-box"><table class="{name}">'), heads, *rows, F.lit("</table></div>"))
    boss = lambda name: F.concat(F.lit('<td><img src="/i/4.png?v=2"><div>'), name, F.lit("</div></td>"))
    img = lambda n: f'<td><img src="http://i/{n}.png?1"></td>' if n else "<td></td>"
    row = lambda time, *icons: F.lit(f"<tr><td>{time} ～ x</td>" + "".join(map(img, icons)) + "</tr>")
    html = F.concat(
        F.lit('<div><h3 id="panigarm"><a href="/sc/public/playguide/guide_'), "s_suppkey", F.lit('/">p</a></h3>'),
        table("t", F.lit("<tr><th>boss</th>"), boss(F.col("s_name")), boss(F.lit(" ")), boss(F.concat("s_name", F.lit(" x"))), F.lit("</tr>")),
        F.lit('</div><div><h3 id="raid">r</h3><div class="tokoyami-box">note</div>'), table("tokoyami-raid", row("6:00", "a", None, "c"), row("5:30", None, "b", None)),
        F.lit('</div><div><h3 id="togabito">t</h3>'), table("tokoyami", F.lit("<tr>" + "".join(map(img, "012")) + "</tr>")), F.lit("</div>"),
    )
    return H.forecast(s.select(F.col("s_suppkey").alias("page"), html.alias("html")), "page", "html", F.lit("2024-02-15").cast("date"))
