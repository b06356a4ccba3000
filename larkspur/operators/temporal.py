"""Interval algebra: tolerance and overlap joins, runs, clusters, lanes, agendas, recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from .folds import sorted_fold


def micros(t: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tolerance: int) -> DataFrame:
    """Pairs with equal `on` columns and |left_at - right_at| <= tolerance (whole numbers).

    Values are cut into buckets of the tolerance's width; the left side looks into
    its own and both neighbouring buckets, so the join is by equality and each
    pair meets once.
    """
    width = max(int(tolerance), 1)
    lb = F.floor(F.col(left_at) / width)
    left = left.withColumn("_bucket", F.explode(F.array(lb - 1, lb, lb + 1)))
    right = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    joined = left.join(right, [*on, "_bucket"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= tolerance)
    return joined.drop("_bucket")


def close_pairs(left: DataFrame, right: DataFrame, on: list[str], tolerance: int, keys: tuple[str, str]) -> DataFrame:
    """Distinct key pairs whose starts, or both present ends, lie within the tolerance.

    left has columns ls, le and right rs, re (whole numbers): one band join each for
    starts and ends, then a union without repeats.
    """
    a, b = keys
    starts = band_join(left, right, on, "ls", "rs", tolerance).select(a, b)
    ends = band_join(left.where("le is not null"), right.where("re is not null"), on, "le", "re", tolerance).select(a, b)
    return starts.unionByName(ends).distinct()


def hull_prune(pool: DataFrame, batch: DataFrame, at: str, batch_at: str, tolerance: int) -> DataFrame:
    """Rows of the pool within the tolerance of the batch's range: a cheap superset of close ones."""
    hull = batch.agg((F.min(batch_at) - tolerance).alias("_low"), (F.max(batch_at) + tolerance).alias("_high"))
    return pool.crossJoin(F.broadcast(hull)).where(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")  # one row


def overlapping_days(events: DataFrame, start: str, end: str) -> DataFrame:
    """(event, day) for each day that an event overlaps: start < day end and (start >= day start or end > day start).

    Days come from the event itself, so the cost is the number of result rows; an
    event without an end, or one that ends at its start, counts for its start's day.
    """
    last = F.greatest(F.to_date(start), F.to_date(F.expr(f"coalesce({end}, {start}) - interval 1 microsecond")))
    return events.withColumn("day", F.explode(F.sequence(F.to_date(start), last)))


def effective_end(kind: str, start: str, end: str) -> Column:
    """allDay lasts a day; marks and rows without an end are points."""
    return F.when(F.col(kind) == "allDay", F.expr(f"{start} + interval 1 day")).when((F.col(kind) == "mark") | F.col(end).isNull(), F.col(start)).otherwise(F.col(end))


def day_fraction(at: Column, day: Column) -> Column:
    """Share of the day that has passed at an instant, between 0 and 1."""
    return F.least(F.greatest((micros(at) - micros(day.cast("timestamp"))) / 86_400_000_000, F.lit(0.0)), F.lit(1.0))


def next_or_period(df: DataFrame, partition: list[str], start: str, period: str, name: str = "end", *ties: str) -> DataFrame:
    """End of a row: the next row's start, or its own start plus a period for the last."""
    w = Window.partitionBy(*partition).orderBy(start, *ties)
    return df.withColumn(name, F.coalesce(F.lead(start).over(w), F.expr(f"{start} + interval {period}")))


def merged_runs(df: DataFrame, partition: list[str], order: list[str], same: list[str], start: str, end: str | None = None) -> DataFrame:
    """Contiguous equal rows become one, with the first start and the last end.

    A run breaks when a `same` column changes or (with an end) a row does not start
    where the one before ended.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    breaks = F.lit(False)
    for c in same:
        breaks = breaks | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if end:
        breaks = breaks | ~F.col(start).eqNullSafe(F.lag(end).over(w))
    marked = df.withColumn("_new", breaks.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, *same, "run").agg(F.min(start).alias("start"), F.max(end or start).alias("end"), F.count("*").alias("rows"))


def overlap_clusters(df: DataFrame, partition: list[str], start: str, end: str, *ties: str, name: str = "cluster") -> DataFrame:
    """Numbers clusters of overlapping intervals: a new one begins where a start is not before all earlier ends."""
    w = Window.partitionBy(*partition).orderBy(start, *ties)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lanes(df: DataFrame, cluster: list[str], start: str, end: str, key: str) -> DataFrame:
    """(cluster..., key, lane, lanes): first lane whose last end is not after the start, in order of start.

    First fit needs the ends of all lanes so far, which no window function has: a
    fold over the sorted rows of a cluster keeps one end for each lane.
    """

    def place(ends, s, _, e):
        lane = next((i for i, last in enumerate(ends) if last <= s), len(ends))
        ends[lane : lane + 1] = [e]
        return ends, (lane,)

    packed = sorted_fold(df, cluster, [start, key], [end], [StructField("lane", IntegerType())], list, place)
    return packed.withColumn("lanes", F.max("lane").over(Window.partitionBy(*cluster)) + 1).select(*cluster, key, "lane", "lanes")


def day_agenda(events: DataFrame, day: Column, swimlane: str) -> DataFrame:
    """One row for each event of a day: section, fractions, open ends, and lane for timed events.

    All-day rows form the band; marks and points are milestones; the rest are bars,
    clustered and packed into lanes inside their swimlane.
    """
    day_start = day.cast("timestamp")
    ends = events.withColumn("_end", effective_end("type", "start", "end"))
    shown = ends.where((micros("start") < micros(day_start) + 86_400_000_000) & ((micros("start") >= micros(day_start)) | (micros("_end") > micros(day_start))))
    shown = (
        shown.withColumn("section", F.when(F.col("type") == "allDay", "band").when(F.col("start") == F.col("_end"), "milestone").otherwise("bar"))
        .withColumn("from", day_fraction(F.col("start"), day))
        .withColumn("to", day_fraction(F.col("_end"), day))
        .withColumn("open_start", micros("start") < micros(day_start))
        .withColumn("open_end", micros("_end") > micros(day_start) + 86_400_000_000)
    )
    bars = overlap_clusters(shown.where("section = 'bar'"), [swimlane], "start", "_end", "id")
    packed = lanes(bars, [swimlane, "cluster"], "start", "_end", "id")
    return shown.join(packed.select("id", "lane", "lanes"), "id", "left").drop("_end")


_DAYS = {"MO": 0, "TU": 1, "WE": 2, "TH": 3, "FR": 4, "SA": 5, "SU": 6}


def recurrences(rules: DataFrame, first: Column, last: Column, time_of_day: str = "0 hours") -> DataFrame:
    """Rules (id, rrule, ...) expanded to one row for each date of the inclusive window, as `at`.

    Understands FREQ=DAILY, WEEKLY with BYDAY and MONTHLY with BYMONTHDAY, with BYHOUR
    and BYMINUTE; a rule that is malformed or of another form gives no rows.
    """
    part = lambda name: F.nullif(F.regexp_extract("rrule", rf"(?:^|[;:]){name}=([^;]*)", 1), F.lit(""))
    days = F.transform(F.split(part("BYDAY"), ","), lambda d: F.element_at(F.create_map(*[x for k, v in _DAYS.items() for x in (F.lit(k), F.lit(v))]), d))
    months = F.transform(F.split(part("BYMONTHDAY"), ","), lambda d: d.try_cast("int"))
    spine = rules.withColumn("_freq", part("FREQ")).withColumn("_days", days).withColumn("_months", months)
    spine = spine.withColumn("_hour", F.coalesce(part("BYHOUR").try_cast("int"), F.lit(0))).withColumn("_minute", F.coalesce(part("BYMINUTE").try_cast("int"), F.lit(0)))
    spine = spine.withColumn("date", F.explode(F.sequence(first, last, F.expr("interval 1 day"))))
    d = F.col("date")
    last_day = F.dayofmonth(F.last_day(d))
    monthly = F.array_contains("_months", F.dayofmonth(d)) | F.array_contains("_months", F.dayofmonth(d) - last_day - 1)
    hits = F.when(F.col("_freq") == "DAILY", F.lit(True)).when(F.col("_freq") == "WEEKLY", F.array_contains("_days", F.weekday(d))).when(F.col("_freq") == "MONTHLY", monthly).otherwise(F.lit(False))
    at = F.timestamp_micros(micros(d.cast("timestamp")) + (F.col("_hour") * 60 + F.col("_minute")).cast("long") * 60_000_000)
    return spine.where(F.coalesce(hits, F.lit(False))).withColumn("at", at).drop("_freq", "_days", "_months", "_hour", "_minute")


def merged_recurrences(expanded: DataFrame, languages: list[str], separator: str = " / ") -> DataFrame:
    """One event for each instant: its members in order, and names joined for each language.

    A name falls back from the language to English to the base title.
    """
    # maps have no order, so the comparison is by the two leading fields
    before = lambda a, b: F.when((a["sort_order"] < b["sort_order"]) | ((a["sort_order"] == b["sort_order"]) & (a["id"] < b["id"])), -1).when((a["sort_order"] == b["sort_order"]) & (a["id"] == b["id"]), 0).otherwise(1)
    members = F.array_sort(F.collect_list(F.struct("sort_order", "id", "title_ja", "titles")), before)
    grouped = expanded.groupBy("at").agg(members.alias("_m"))
    names = [F.array_join(F.transform("_m", lambda m: F.coalesce(F.element_at(m["titles"], lang), F.element_at(m["titles"], "en"), m["title_ja"])), separator).alias(f"title_{lang}") for lang in languages]
    return grouped.select("at", F.transform("_m", lambda m: m["id"]).alias("members"), F.array_join(F.transform("_m", lambda m: m["title_ja"]), separator).alias("title_ja"), *names)


def schedule_rows(slots: DataFrame, grid: DataFrame, per_day: DataFrame, period: str) -> DataFrame:
    """Rotation slots up to their successor, icon grids merged into runs, and per-day rows, in one shape."""
    boss = next_or_period(slots, ["content"], "start", period).select("content", "icon", "start", "end")
    icons = merged_runs(grid, ["content"], ["start", "icon"], ["icon"], "start", "end").select("content", "icon", "start", "end")
    return boss.unionByName(icons).unionByName(per_day.select("content", "icon", "start", "end"))
