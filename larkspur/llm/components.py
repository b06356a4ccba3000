"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  A step is
one sum and one join on tables in the shared folder, so a hub with very many
links is split like any skewed join, and no component is ever held in one task.
A table of at most ONE_TASK links needs no steps: one task holds it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, tidy, written

#: Links that one task works on (16 bytes each).
ONE_TASK = 1 << 17


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(_least(both))
    out = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(_least(down))
    joined = down.join(least, "u")
    out = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    dropped(least)
    return out


def _whole(batches):
    """Components of all links of a small table, by the least neighbour's label and pointer jumping."""
    batches = list(batches)
    u, v = (np.concatenate([np.asarray(b.column(c)) for b in batches]) if batches else np.zeros(0, np.int64) for c in (0, 1))
    ids, at = np.unique(np.r_[u, v], return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the least id reachable.

    Links may repeat, go either way or join an id to itself; ids alone in a link to
    themselves are left out.  Runs until a step changes nothing.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if links.count() <= ONE_TASK:
        out = written(links.coalesce(1).mapInArrow(tidy(_whole), "id long, component long"))
        dropped(links)
        return out
    now = written(links.distinct())
    dropped(links)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        large = _large_star(now)
        dropped(now)
        now = _small_star(large)
        dropped(large)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
