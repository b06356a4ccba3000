"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors become one class.  Class vectors are dealt to overlapping shards: those
of their nearest centroids, and in a larger table of the nearest centroids of what
the first ones leave (a shared second codebook), so that the number of shards grows
with the table while the centroids keep a fixed bound.

Each shard builds a pruned neighbour graph: candidates come from the leaves of
random-projection trees, and robust pruning keeps some of them; no shard compares all
its vectors.  The adjacency lists of a vector from all its shards are united.  Every
vector then searches its shards, greedily from the medoid and from its own list, and
widens the search around all it finds within the range.  Where what it finds also
lies in shards that it is not in itself, it goes there as a guest and searches on,
until nothing new is found.

Found pairs are verified by cosine in double precision and stay inside their task:
it returns for each vector the number of its links (a pair counts in one shard only)
and the least vector it is connected with, never the pairs of a group.  Recall is
audited against brute force; a poor audit repeats the build with more overlap, and
after AUDIT_TRIES builds all pairs are compared.

Centroids are fitted on a sample of FIT_SAMPLE vectors at most; all vectors are
indexed.  A shard that is still too large (one very dense group) is cut into blocks
and worked on in pairs of blocks, so tasks stay bounded and no pair is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, tidy, written

COSINE = 0.95
FIT_SAMPLE = 20_000
#: Vectors that a shard is to have, and has at most; fewer of more than 128 dimensions (SHARD_BYTES).
SHARD_AIM = 2048
SHARD_MOST = 16384
SHARD_BYTES = 16 << 20
#: Centroids of a codebook; two codebooks make up to 4 million shards.
CENTROIDS_MOST = 2048
OVERLAP = 3
DEGREE = 24
TREES = 10
LEAF = 64
NEAREST = 8
RANDOM = 8
ALPHA = 1.2
BEAM = 12
#: Nodes of the beam whose lists are read in a step.
EXPAND = 2
#: Queries that search at once; a multiple of 8.
QUERY_BLOCK = 256
AUDIT_SAMPLE = 200
AUDIT_RECALL = 0.95
AUDIT_TRIES = 3
#: Vectors in a block where all pairs are compared.
EXACT_BLOCK = 8192


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of doubles."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(len(column), width)


def _classes(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, key, vector): key of equal vectors, or null where a vector links with nothing."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, out = [], []
            lists = batch.column(1)
            for vec_id, x in zip(batch.column(0), lists):
                v = None
                if vec_id.is_valid and x.is_valid and len(x.values) and x.values.null_count == 0:
                    v = np.zeros(width)
                    v[: len(x.values)] = x.values.to_numpy(zero_copy_only=False)
                    v = v if np.isfinite(v).all() and v.any() else None
                keys.append(None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
                out.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "key", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(tidy(run), f"vec_id {kind}, key binary, vector binary")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows with components of 1 at most: their squares neither overflow nor vanish."""
    return x / np.abs(x).max(1, keepdims=True) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means; sample rows are in a fixed order, so the result is reproducible."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.permutation(len(sample))[:k]]
    for _ in range(steps):
        near = np.argmax(sample @ centroids.T, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def _leaves(x: np.ndarray, rng) -> np.ndarray:
    """Row numbers by leaves of a random-projection tree, LEAF in each (n is padded with repeated rows)."""
    levels = max(0, int(np.ceil(np.log2(max(1, len(x) / LEAF)))))
    size = -(-len(x) // (1 << levels)) << levels
    order = np.r_[np.arange(len(x)), rng.integers(0, len(x), size - len(x))]
    for level in range(levels):
        along = (x[order] @ rng.normal(size=x.shape[1]).astype(x.dtype)).reshape(1 << level, -1)
        order = np.take_along_axis(order.reshape(along.shape), np.argsort(along, axis=1), 1).ravel()
    return order.reshape(1 << levels, -1)


def _near_candidates(x: np.ndarray, rng) -> np.ndarray:
    """(n, TREES * NEAREST + RANDOM) candidates of each row: the nearest in its leaf of every tree, and some at random."""
    n = len(x)
    out = np.repeat(np.arange(n)[:, None], TREES * NEAREST + RANDOM, 1)
    for tree in range(TREES):
        leaves = _leaves(x, rng)
        most = min(NEAREST, leaves.shape[1] - 1)
        if most < 1:
            continue
        for a in range(0, len(leaves), 64):
            own = leaves[a : a + 64]
            sims = np.matmul(x[own], x[own].transpose(0, 2, 1))
            sims[:, np.arange(own.shape[1]), np.arange(own.shape[1])] = -3
            best = np.argpartition(-sims, most - 1, axis=2)[:, :, :most]
            out[own.ravel(), tree * NEAREST : tree * NEAREST + most] = np.take_along_axis(own[:, None, :], best, 2).reshape(-1, most)
    out[:, TREES * NEAREST :] = rng.integers(0, n, (n, RANDOM))
    return out


def pruned_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbours (n x DEGREE, padded with the row itself) by robust pruning.

    A candidate goes once a kept neighbour is ALPHA times nearer to it than the
    vector is; candidates are near vectors and some others, for long links.
    """
    x = x.astype(np.float32)
    n = len(x)
    every = _near_candidates(x, np.random.default_rng(seed))
    lists = np.repeat(np.arange(n)[:, None], DEGREE, 1)
    for a in range(0, n, QUERY_BLOCK):
        cand = np.sort(every[a : a + QUERY_BLOCK], 1)
        rows = np.arange(len(cand))
        there = x[cand]
        dist = 2 - 2 * np.matmul(there, x[a : a + len(cand), :, None])[:, :, 0]
        alive = (cand != (a + rows)[:, None]) & np.c_[np.ones(len(cand), bool), cand[:, 1:] != cand[:, :-1]]
        for k in range(DEGREE):
            pick = np.argmin(np.where(alive, dist, np.inf), 1)
            left = alive[rows, pick]
            if not left.any():
                break
            chosen = cand[rows, pick]
            lists[a + rows[left], k] = chosen[left]
            between = 2 - 2 * np.matmul(there, x[chosen][:, :, None])[:, :, 0]
            alive &= ~((ALPHA * between <= dist) & left[:, None])
            alive[rows, pick] = False
    return lists


class Graph:
    """Vectors with their lists, padded with the row itself; `to` holds links both ways: whoever is near a vector also leads back to it."""

    def __init__(self, x: np.ndarray, source: np.ndarray, target: np.ndarray):
        self.x = x.astype(np.float32)
        n = len(x)
        there = np.unique(source * n + target)
        source, target = there // max(n, 1), there % max(n, 1)
        place = np.arange(len(source)) - np.searchsorted(source, source)
        self.lists = np.repeat(np.arange(n)[:, None], int(place.max(initial=0)) + 1, 1)
        self.lists[source, place] = target
        pairs = np.unique(np.r_[there, target * n + source])
        self.to = pairs % max(n, 1)
        self.edge = np.searchsorted(pairs, np.arange(n + 1) * n)
        self.medoid = int(np.argmax(self.x @ self.x.mean(0))) if n else 0

    def search(self, queries: np.ndarray, low: float, own: np.ndarray | None = None) -> np.ndarray:
        """Which nodes are found in range of each query: a beam from the medoid and the queries' own places, then widened."""
        q, m, n = queries.astype(np.float32), len(queries), len(self.x)
        seen, found = np.zeros((m, n), bool), np.zeros((m, n), bool)
        width = min(BEAM, n)
        ids, sims = np.full((m, width), self.medoid), np.full((m, width), -3.0, np.float32)
        sims[:, 0] = q @ self.x[self.medoid]
        if own is not None and width > 1:
            ids[:, 1], sims[:, 1] = own, np.where(own == self.medoid, -3.0, np.einsum("qd,qd->q", q, self.x[own]))
        rows = np.arange(m)[:, None]
        seen[rows, ids] = True
        found[rows, ids] = sims >= low
        open_ = sims > -3
        active = np.arange(m)
        step = min(EXPAND, width)
        while len(active):
            pick = np.argpartition(-np.where(open_[active], sims[active], -4.0), step - 1, axis=1)[:, :step]
            nodes = np.where(np.take_along_axis(open_[active], pick, 1), np.take_along_axis(ids[active], pick, 1), ids[active, pick[:, 0]][:, None])
            open_[active[:, None], pick] = False
            near = np.sort(self.lists[nodes].reshape(len(active), -1), 1)
            new = ~seen[active[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(new)
            v = near[r, c]
            seen[active[r], v] = True
            s = np.full(near.shape, -3.0, np.float32)
            s[r, c] = np.einsum("pd,pd->p", q[active[r]], self.x[v])
            found[active[r], v] = s[r, c] >= low
            every, all_sims = np.c_[ids[active], near], np.c_[sims[active], s]
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active] = np.take_along_axis(every, top, 1), np.take_along_axis(all_sims, top, 1)
            open_[active] = np.take_along_axis(np.c_[open_[active], new], top, 1)
            active = active[open_[active].any(1)]
        r, v = np.nonzero(found)
        while len(r):
            r, v = self._widen(q, low, seen, found, r, v)
        return found

    def _widen(self, q, low, seen, found, r, v) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) newly found among the neighbours of pairs found before."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(r), 1 << 15):
            nodes = v[a : a + (1 << 15)]
            n = self.edge[nodes + 1] - self.edge[nodes]
            query = np.repeat(r[a : a + (1 << 15)], n)
            node = self.to[np.repeat(self.edge[nodes] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            new = ~seen[query, node]
            pairs = np.unique(query[new] * len(self.x) + node[new])
            query, node = pairs // len(self.x), pairs % len(self.x)
            seen[query, node] = True
            good = np.zeros(len(query), bool)
            for b in range(0, len(query), 1 << 16):
                good[b : b + (1 << 16)] = np.einsum("pd,pd->p", q[query[b : b + (1 << 16)]], self.x[node[b : b + (1 << 16)]]) >= low
            found[query[good], node[good]] = True
            out.append((query[good], node[good]))
        return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def range_search(x: np.ndarray, lists: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) for every row as a query on its graph; the caller verifies what is found."""
    n = len(x)
    graph = Graph(x, np.repeat(np.arange(n), lists.shape[1]), lists.ravel())
    parts = []
    for a in range(0, n, QUERY_BLOCK):
        own = np.arange(a, min(n, a + QUERY_BLOCK))
        found = graph.search(x[own], cosine - 1e-4, own)
        found[np.arange(len(own)), own] = False
        r, v = np.nonzero(found)
        parts.append((own[r], v))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int))


class Exact:
    """Cosines of rows in double precision; rows are scaled first, so none overflows."""

    def __init__(self, raw: np.ndarray):
        self.x = _scaled(raw)
        self.norm = np.sqrt((self.x * self.x).sum(1))

    def reach(self, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 16):
            e, f = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            keep[k : k + (1 << 16)] = np.einsum("pd,pd->p", self.x[e], self.x[f]) / (self.norm[e] * self.norm[f]) >= cosine
        return keep


class Codebooks:
    """Two codebooks of centroids: the second one for what the first leaves of a vector."""

    def __init__(self, sample: np.ndarray, shards: int):
        k = int(min(CENTROIDS_MOST, max(1, shards), len(sample)))
        self.first = fit_centroids(sample, k)
        self.second = None
        if shards > CENTROIDS_MOST:
            rest = sample - self.first[np.argmax(sample @ self.first.T, 1)]
            self.second = fit_centroids(rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12), int(min(CENTROIDS_MOST, -(-shards // CENTROIDS_MOST), len(sample))))

    def shards(self, x: np.ndarray, overlap: int) -> np.ndarray:
        """Different shards of each unit vector, in increasing order."""
        sims = x @ self.first.T
        most = min(overlap, len(self.first))
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        if self.second is None:
            return np.sort(near, 1).astype(np.int64)
        two = min(2, len(self.second))
        out = []
        for j in range(most):
            rest = x - self.first[near[:, j]]
            then = np.argpartition(-(rest @ self.second.T), two - 1, axis=1)[:, :two]
            out.append(near[:, j, None].astype(np.int64) * len(self.second) + then)
        return np.sort(np.concatenate(out, 1), 1)


def _shard_sizes(width: int) -> tuple[int, int]:
    """(aim, most) vectors of a shard."""
    most = max(64, min(SHARD_MOST, SHARD_BYTES // (8 * width)))
    return min(SHARD_AIM, max(8, most // 8)), most


def _dealt(reps: DataFrame, books: Codebooks, width: int, overlap: int) -> DataFrame:
    """(shard, i, j, block, id, members, vector, shards): vectors in their shards, large shards cut into pairs of blocks."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(books)
    most = _shard_sizes(width)[1]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = shared.value.shards(_unit(_matrix(batch.column(2), width)), overlap)
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            lists = pa.array(list(near), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *(c.take(at) for c in batch.columns), lists.take(at)], ["shard", "id", "members", "vector", "shards"])

    dealt = written(reps.select("id", "members", "vector").mapInArrow(tidy(assign), "shard long, id long, members long, vector binary, shards array<long>"))
    large = dealt.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(most)).alias("blocks")).where("blocks > 1")
    dealt = dealt.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    # two blocks or more: only pairs of different blocks, which also hold each block's own pairs
    dealt = dealt.select("*", other).where("blocks = 1 or other <> block")
    return dealt.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "members", "vector", "shards")


class Found:
    """The pairs that a task finds, as bits of an n x n table (32 MB for the largest shard), and what it returns of them."""

    SCHEMA = "id long, others long, root long, guest_of array<long>"

    def __init__(self, ids: np.ndarray, members: np.ndarray):
        self.ids, self.members = ids, members
        self.bits = np.zeros((len(ids), -(-len(ids) // 8)), np.uint8)

    def add(self, first: int, found: np.ndarray) -> None:
        """found: a row for each query from row `first` on."""
        self.bits[first : first + len(found)] |= np.packbits(found, axis=1)

    def pairs(self):
        """(r, v) by blocks of rows; a pair found one way only comes both ways."""
        n = len(self.ids)
        for a in range(0, n, QUERY_BLOCK):
            b = min(n, a + QUERY_BLOCK)
            rows = np.unpackbits(self.bits[a:b], axis=1, count=n)
            rows |= np.unpackbits(self.bits[:, a // 8 : -(-b // 8)], axis=1)[:, : b - a].T
            r, v = np.nonzero(rows)
            yield a + r, v

    def summary(self, counts_here=None, guest_of=None) -> pa.Table:
        """For each row with a link: links that count here (all, or by counts_here(r, v)), and the least id connected with it."""
        n, ids = len(self.ids), self.ids
        order = np.argsort(ids, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        others, root, first = np.zeros(n, np.int64), rank.copy(), True
        while True:
            before = root.copy()
            for r, v in self.pairs():
                if first and len(r):
                    np.add.at(others, r, self.members[v] if counts_here is None else np.where(counts_here(r, v), self.members[v], 0))
                np.minimum.at(root, r, root[v])
            root, first = np.minimum(root, root[order[root]]), False
            if (root == before).all():
                break
        guest_of = guest_of or [[]] * n
        some = np.flatnonzero((root != rank) | (others > 0) | np.array([len(g) > 0 for g in guest_of], bool))
        return pa.table({"id": pa.array(ids[some]), "others": pa.array(others[some]), "root": pa.array(ids[order[root[some]]]), "guest_of": pa.array([guest_of[k] for k in some], pa.list_(pa.int64()))})


def _first_common(shards: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least shard that both of a pair are in; shards are sorted rows."""
    out = np.full(len(r), np.iinfo(np.int64).max)
    for i in range(shards.shape[1]):
        own = shards[r, i]
        for j in range(shards.shape[1]):
            out = np.where((own == shards[v, j]) & (own < out), own, out)
    return out


def _rows_of(table: pa.Table, width: int):
    """(ids, vectors as they are, unit vectors)."""
    ids = table.column("id").to_numpy()
    raw = _matrix(table.column("vector"), width)
    return ids, raw, _unit(raw) if len(raw) else raw


def _local_graph(x, ids, near: pa.Array) -> Graph:
    """The part of the united lists between rows that are here."""
    flat, lengths = near.flatten().to_numpy(), near.value_lengths().to_numpy()
    order = np.argsort(ids, kind="stable")
    at = order[np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)]
    inside = ids[at] == flat
    return Graph(x, np.repeat(np.arange(len(ids)), lengths)[inside], at[inside])


def linked(reps: DataFrame, width: int, books: Codebooks, overlap: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(rows (id, others, root), pairs (a, b)) for reps (id, members, vector).

    others: links to members of other classes that a task has counted for the id;
    root: an id it is connected with; an id may have several rows.  pairs with a < b
    are links between shards, each once, which no row counts.
    """
    dealt = written(_dealt(reps, books, width, overlap))

    def build(table):
        ids, _, x = _rows_of(table, width)
        return pa.table({"id": pa.array(ids), "near": pa.array(list(ids[pruned_graph(x)]), pa.list_(pa.int64()))})

    parts = dealt.groupBy("shard", "i", "j").applyInArrow(build, "id long, near array<long>")
    union = parts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = written(dealt.join(written(union), "id"))

    def search(key, table):
        shard, i, j = (k.as_py() for k in key)
        ids, raw, x = _rows_of(table, width)
        members, block = table.column("members").to_numpy(), table.column("block").to_numpy()
        shards = np.stack(table.column("shards").to_numpy(zero_copy_only=False))
        net = _local_graph(x, ids, table.column("near").combine_chunks())
        every, of = np.unique(shards, return_inverse=True)
        mine = np.zeros((len(ids), len(every)), np.float32)
        np.put_along_axis(mine, of.reshape(shards.shape), 1, 1)
        exactly, links, guest_of = Exact(raw), Found(ids, members), []
        for a in range(0, len(ids), QUERY_BLOCK):
            own = np.arange(a, min(len(ids), a + QUERY_BLOCK))
            found = net.search(x[own], cosine - 1e-4, own)
            found[np.arange(len(own)), own] = False
            r, v = np.nonzero(found)
            found[r, v] = exactly.reach(own[r], v, cosine)
            links.add(a, found)
            guest_of += [every[w].tolist() for w in (found.astype(np.float32) @ mine > 0) & (mine[own] == 0)]

        def counts_here(r, v):
            """A pair counts in the first shard, and there in the first pair of blocks, that holds both."""
            here = _first_common(shards, r, v) == shard
            return here if i == j else here & ((block[r] != block[v]) | (np.where(block[r] == i, j, i) == np.where(block[r] == 0, 1, 0)))

        return links.summary(counts_here, guest_of)

    found = written(graph.groupBy("shard", "i", "j").applyInArrow(search, Found.SCHEMA))
    pairs = _guests(reps, graph, found, width, cosine)
    dropped(dealt, graph)
    return found.select("id", "others", "root"), pairs


def _guests(reps: DataFrame, graph: DataFrame, found: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, b) with a < b: links between vectors that share no shard, which others in range of both lead to.

    A vector goes as a guest to each shard of what it is linked with, once.
    """
    homes = graph.select("id", "shards").distinct()
    wanted = written(found.select("id", F.explode("guest_of").alias("shard")).distinct())
    pairs, been = None, wanted

    def visit(key, table):
        ids, raw, x = _rows_of(table, width)
        shards = table.column("shards").to_pylist()
        guest = table.column("near").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        hosts, visitors = np.flatnonzero(~guest), np.flatnonzero(guest)
        out, exactly = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], Exact(raw)
        if len(hosts):
            host_table = table.take(pa.array(hosts))
            net = _local_graph(x[hosts], ids[hosts], host_table.column("near").combine_chunks())
            for a in range(0, len(visitors), QUERY_BLOCK):
                some = visitors[a : a + QUERY_BLOCK]
                r, v = np.nonzero(net.search(x[some], cosine - 1e-4))
                r, v = some[r], hosts[v]
                keep = exactly.reach(r, v, cosine)
                apart = np.array([not set(shards[p]) & set(shards[q]) for p, q in zip(r[keep].tolist(), v[keep].tolist())], bool)
                out.append((ids[r[keep][apart]], ids[v[keep][apart]]))
        one, two = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.table({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    while True:
        guests = wanted.join(reps.select("id", "members", "vector"), "id").join(homes, "id")
        here = graph.join(wanted.select("shard").distinct(), "shard", "left_semi").select("shard", "i", "j", "id", "vector", "shards", "near")
        blocks = here.select("shard", "i", "j").distinct()
        guests = guests.join(blocks, "shard").select("shard", "i", "j", "id", "vector", "shards", F.lit(None).cast("array<long>").alias("near"))
        new = here.unionByName(guests).groupBy("shard", "i", "j").applyInArrow(visit, "a long, b long").distinct()
        new = written(new if pairs is None else new.join(pairs, ["a", "b"], "left_anti"))
        pairs = new if pairs is None else pairs.unionByName(new)
        if new.isEmpty():
            return pairs
        ways = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lead = ways.join(homes.withColumnsRenamed({"id": "b", "shards": "there"}), "b").join(homes.withColumnsRenamed({"id": "a", "shards": "own"}), "a")
        lead = lead.select(F.col("a").alias("id"), F.explode(F.array_except("there", "own")).alias("shard")).distinct()
        wanted = written(lead.join(been, ["id", "shard"], "left_anti"))
        been = been.unionByName(wanted)


def exact(reps: DataFrame, width: int, cosine: float) -> DataFrame:
    """(id, others, root) as linked gives them, by comparing all blocks with each other."""
    blocks = max(1, -(-reps.count() // EXACT_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    rows = reps.select("id", "members", "vector", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "members", "vector")

    def compare(key, table):
        i, j = (k.as_py() for k in key)
        of, members = table.column("block").to_numpy(), table.column("members").to_numpy()
        ids, raw, x = _rows_of(table, width)
        left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
        exactly, links = Exact(raw), Found(ids, members)
        for k in range(0, len(left), QUERY_BLOCK):
            some = left[k : k + QUERY_BLOCK]
            r, c = np.nonzero(x[some] @ x[right].T >= cosine - 1e-9)
            found = np.zeros((len(some), len(ids)), bool)
            found[r, right[c]] = (some[r] != right[c]) & exactly.reach(some[r], right[c], cosine)
            for row, own in enumerate(some):
                links.add(int(own), found[row : row + 1])
        return links.summary()

    return rows.groupBy("i", "j").applyInArrow(compare, Found.SCHEMA).select("id", "others", "root")


def _links(reps: DataFrame, rows: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(id, others): links of each id to members of other classes."""
    counts = rows.select("id", "others")
    if pairs is not None:
        weight = reps.select(F.col("id").alias("b"), F.col("members").alias("others"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counts = counts.unionByName(both.join(weight, "b").select(F.col("a").alias("id"), "others"))
    return counts.groupBy("id").agg(F.sum("others").alias("others")).where("others > 0")


def audit(reps: DataFrame, links: DataFrame, width: int, cosine: float) -> float:
    """Share of true links, by brute force against all, that were found: the lesser of two samples.

    AUDIT_SAMPLE vectors of all, and as many of those with a link, which a sample of
    all may miss where links are rare.
    """
    return min(_recall(some, reps, links, width, cosine) for some in (reps, reps.join(links, "id", "left_semi")))


def _recall(some: DataFrame, reps: DataFrame, links: DataFrame, width: int, cosine: float) -> float:
    rows = some.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(AUDIT_SAMPLE).select("id", "vector").collect()
    if not rows:
        return 1.0
    ids = np.array([r["id"] for r in rows])
    sample = np.stack([np.frombuffer(r["vector"]) for r in rows])
    shared = reps.sparkSession.sparkContext.broadcast((ids, _unit(sample)))

    def brute(batches):
        mine, q = shared.value
        for batch in batches:
            if batch.num_rows:
                near = q @ _unit(_matrix(batch.column(2), width)).T >= cosine
                near &= mine[:, None] != np.asarray(batch.column(0))[None, :]
                n = near @ np.asarray(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(n.astype(np.int64))], ["id", "n"])

    true = reps.select("id", "members", "vector").mapInArrow(tidy(brute), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    n, held = true.join(links, "id", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("others", F.lit(0))))).first()
    return held / n if n else 1.0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, audited_recall, for vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite parts, and rows
    with a null vec_id, link with nothing.  Shorter vectors count as padded with
    zeros.  Equal vectors link with each other; repeated rows count as vectors of
    their own.  Other columns, labels too, are not read.  audited_recall is the
    share of true links found for the audited vectors (1 where all pairs were compared).
    """
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width < 1:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audited_recall"))
    rows = written(_classes(vectors, width))
    valid = rows.where("key is not null")
    reps = written(valid.groupBy("key").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("members"), F.first("vector").alias("vector")))
    n, recall = reps.count(), 1.0
    if n:
        sample = reps.orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).select("vector").collect()
        books = Codebooks(_unit(np.stack([np.frombuffer(r["vector"]) for r in sample])), n // _shard_sizes(width)[0])
        overlap = OVERLAP
        for _ in range(AUDIT_TRIES):
            found, pairs = linked(reps, width, books, overlap, cosine)
            links = written(_links(reps, found, pairs))
            recall = audit(reps, links, width, cosine)
            if recall >= AUDIT_RECALL:
                break
            overlap *= 2
        else:
            found, pairs, recall = written(exact(reps, width, cosine)), None, 1.0
            links = written(_links(reps, found, None))
        edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        label = components(edges if pairs is None else edges.unionByName(pairs))
        classes = reps.select("key", "id", "members").join(links, "id", "left").join(label, "id", "left")
        classes = written(classes.select("key", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    else:
        classes = reps.select("key", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.select("vec_id", "key").where("key is not null").join(classes, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(float(recall)))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
