"""Exact Jaccard join of documents by word n-grams, as a blocked sparse product.

The overlap of two documents is an entry of M M', where M is the incidence of
documents by n-grams.  n-grams are ordered from rare to frequent (by a sketch of
counts over all documents), and only a prefix of each row takes part in the first
product: with threshold t, a row of n entries keeps n - ceil(t n) + 1, since two
rows that link must share one of those.  The product accumulates overlaps within
the prefixes; n-grams that a sketch shows to occur once are left out; a pair whose
overlap plus what may still follow lies below the bound given by its sizes is
discarded.  The rest get their full overlap in blocks.

Equal rows count once.  Before the product, each wide column is multiplied with one
row only, and rows found linked are merged; rows outside a column's largest component
then meet other rows of it in turn.  A group of near copies is mostly one component
by then.  What is left of wide columns is multiplied in blocks of rows that accumulate
inside a task, so no column yields its square as rows.  Narrow columns, of WIDE
entries at most, are multiplied where they lie after one exchange.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .shared import bounded_batches, dropped, tidy, written
from .words import U64, mix, shingle_hashes, text_chunks, word_hashes

SHINGLE = 3
THRESHOLD = 90  # hundredths
#: Columns with more entries count as wide and are first multiplied with one of their rows.
WIDE = 16
#: Wide columns meet another row of theirs while they hold more than so many pairs for each entry, at most TURNS rows.
FEW_PAIRS = 4
TURNS = 8
#: Rows of a block of wide columns.
BLOCK = 256
#: The sketch that orders n-grams has 2**24 cells (16 MB as levels); more data blur the order, never the result.
_CELL_BITS = 24
_BLOCK_BITS = 18
#: Pairs that are sent to all executors (32 bytes each, twice); more are joined by an exchange of both sides.
BROADCAST_PAIRS = 1 << 18
#: Partners in a block that meets one copy of a row's set.
PARTNERS = 128


def _rows(column: pa.Array, k: int):
    """(row, sorted distinct hashes) of each text with words."""
    for lo, _, data, offsets in text_chunks(column):
        words, _, first = word_hashes(data, offsets, lower=True)
        shingles, pos = shingle_hashes(words, first, k)
        for i in range(len(pos) - 1):
            yield lo + i, np.unique(shingles[pos[i] : pos[i + 1]])


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, k1, k2) of the sets, and rows (block, counts) of each task's sketch of n-gram counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = ["doc_id", "n", "k1", "k2", "block", "at", "counts"]
        cells, of = np.zeros(1 << _CELL_BITS, np.uint16), pa.int64()
        for batch in batches:
            n, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, own in _rows(batch.column(1), k):
                n[i] = len(own)
                one[i] = np.sum(mix(own), dtype=U64).view(np.int64)
                two[i] = np.sum(mix(own ^ U64(0xA0761D6478BD642F)), dtype=U64).view(np.int64)
                at, more = np.unique((own >> U64(64 - _CELL_BITS)).astype(np.int64), return_counts=True)
                cells[at] = np.minimum(cells[at] + more.astype(np.uint32), 65535)
            of = batch.column(0).type
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), none, *[pa.nulls(batch.num_rows, pa.binary())] * 2], names)
        width, no = 1 << _BLOCK_BITS, pa.nulls(1, pa.int64())
        for block in range(1 << (_CELL_BITS - _BLOCK_BITS)):
            part = cells[block * width : (block + 1) * width]
            at = np.flatnonzero(part > 1)  # what a task meets once is not frequent
            if len(at):
                data = zlib.compress(sketch.pack_sorted(at), 1), zlib.compress(part[at].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, of), no, no, no, pa.array([block], pa.int32()), pa.array([data[0]], pa.binary()), pa.array([data[1]], pa.binary())], names)

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n long, k1 long, k2 long, block int, at binary, counts binary")


def _levels(sketches: DataFrame) -> np.ndarray:
    """Powers of two of the summed counts, one byte for each cell of the sketch; 0 for cells that no task met twice."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                held = sums.setdefault(block, np.zeros(1 << _BLOCK_BITS, np.int64))
                held[sketch.unpack_sorted(zlib.decompress(at.as_py()))] += np.frombuffer(zlib.decompress(counts.as_py()), np.uint16)
        for block, x in sums.items():
            level = np.ceil(np.log2(x + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    out = np.zeros(1 << _CELL_BITS, np.uint8)
    for r in sketches.repartition(64, "block").mapInArrow(tidy(run), "block int, levels binary").collect():
        out[r["block"] << _BLOCK_BITS : (r["block"] + 1) << _BLOCK_BITS] = np.frombuffer(r["levels"], np.uint8)
    return out


def index_length(n, threshold: int):
    """Entries of a row that must meet the prefix of any row of its size or more."""
    return n - -(-2 * threshold * n // (100 + threshold)) + 1


def _prefixes(docs: DataFrame, nodes: DataFrame, levels, k: int, threshold: int) -> DataFrame:
    """(doc_id, n, p, last, index_last, grams): the rarest p of n n-grams in order, and order keys of the last ones.

    For rows of nodes, by a Bloom filter; others that pass it only link with their equal.
    """
    found, bits = sketch.members(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in batches:
            (own,) = sketch.number_keys(batch.select([0]))
            batch = batch.filter(pa.array(sketch.may_repeat(shared.value, own, bits)))
            at, n, p, last, index_last, grams = [], [], [], [], [], []
            for i, own in _rows(batch.column(1), k):
                if not len(own):
                    continue
                keys = _keys(levels.value, own)
                order = np.argsort(keys, kind="stable")
                most = len(own) - -(-threshold * len(own) // 100) + 1
                at.append(i)
                n.append(len(own))
                p.append(most)
                last.append(int(keys[order[most - 1]]))
                index_last.append(int(keys[order[index_length(len(own), threshold) - 1]]))
                grams.append(own[order[:most]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (n, p, last, index_last)), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "n", "p", "last", "index_last", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n long, p long, last long, index_last long, grams array<long>")


def _keys(level: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The order of n-grams: by the level of their cell, then by hash."""
    return (level[(grams >> U64(64 - _CELL_BITS)).astype(np.int64)].astype(U64) << U64(56)) | (mix(grams) >> U64(8))


#: Order keys go along with entries by their leading bits; what they cannot tell counts as undecided.
_KEY_SHIFT = 40
_ENTRY = ("gram", "node", "n", "p", "last", "index_last", "alone", "alone_last", "at")


def _entries(first: DataFrame, levels) -> DataFrame:
    """Prefix entries whose n-gram may occur in another prefix, with their place in the row's order.

    `alone` counts the n-grams of a prefix that certainly occur in no other prefix,
    `alone_last` is the order key of the last of them: a row whose prefix reaches
    that far has none of them at all.
    """
    total = first.agg(F.sum("p")).first()[0] or 0
    bits = sketch.bits_for(total, 4)

    def keys_of(batch):
        yield batch.column(0).flatten().to_numpy().view(U64)

    often = first.sparkSession.sparkContext.broadcast(sketch.repeated_cells(first.select("grams"), keys_of, bits))

    def run(batches):
        for batch in batches:
            node, n, p, last, index_last = (np.asarray(batch.column(k)) for k in range(5))
            grams = batch.column(5).flatten().to_numpy()
            lengths = batch.column(5).value_lengths().to_numpy()
            keep = sketch.may_repeat(often.value, grams.view(U64), bits)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            at = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            alone = np.bincount(row[~keep], minlength=batch.num_rows)
            alone_last = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(alone_last, row[~keep], _keys(levels.value, grams.view(U64)[~keep]).view(np.int64))
            row, at, grams = row[keep], at[keep], grams[keep]
            columns = (node, n, p, last >> _KEY_SHIFT, index_last >> _KEY_SHIFT, alone, alone_last >> _KEY_SHIFT)
            for a in range(0, len(row), 1 << 17):
                r = row[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(grams[a : a + (1 << 17)]), *(pa.array(c[r].astype(np.int64)) for c in columns), pa.array(at[a : a + (1 << 17)].astype(np.int64))], _ENTRY)

    rows = first.select(F.col("doc_id").cast("long").alias("node"), "n", "p", "last", "index_last", "grams")
    return rows.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in _ENTRY))


def _split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of columns that have at most WIDE of them for certain, and all others (by a Bloom filter, so some narrow ones too)."""
    wide = entries.groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") > WIDE).select("gram")
    found, bits = sketch.members(written(wide))
    shared = entries.sparkSession.sparkContext.broadcast(found)

    def part(inside: bool):
        def run(batches):
            for batch in batches:
                (own,) = sketch.number_keys(batch.select([0]))
                yield batch.filter(pa.array(sketch.may_repeat(shared.value, own, bits) == inside))

        return entries.mapInArrow(tidy(run), entries.schema)

    return part(False), written(part(True))


_PAIR = ("node_x", "node_y", "n_x", "n_y", "index_last_x", "last_y", "p_y")


def _narrow_pairs(labelled: DataFrame, threshold: int) -> DataFrame:
    """Pairs (x the shorter row) that share an entry of a narrow column and may link, once for each such column."""
    names = labelled.columns

    def run(batches):
        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.concat_batches([held, batch])
            gram = np.asarray(batch.column(0))
            new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(1, int)
            yield from multiplied(batch.slice(0, int(new[-1])))
            held = batch.slice(int(new[-1]))
        if held is not None:
            yield from multiplied(held)

    def multiplied(batch):
        c = dict(zip(names, (np.asarray(x) for x in batch.columns)))
        for step in range(1, WIDE):
            i = np.flatnonzero(c["gram"][step:] == c["gram"][:-step])
            if not len(i):
                break
            j = i + step
            swap = (c["n"][j] < c["n"][i]) | ((c["n"][j] == c["n"][i]) & (c["node"][j] < c["node"][i]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            x, y = ({k: v[at] for k, v in c.items()} for at in (i, j))
            need = -(-threshold * (x["n"] + y["n"]) // (100 + threshold))
            least = np.minimum(x["n"] - np.where(x["alone_last"] < y["last"], x["alone"], 0), y["n"] - np.where(y["alone_last"] < x["last"], y["alone"], 0))
            ahead = np.minimum(x["at"], y["at"]) + np.minimum(x["n"] - x["at"], y["n"] - y["at"])
            fits = (x["node"] != y["node"]) & (x["component"] != y["component"]) & (x["at"] < index_length(x["n"], threshold)) & (least >= need) & (ahead >= need)
            out = [x["node"], y["node"], x["n"], y["n"], x["index_last"], y["last"], y["p"]]
            yield pa.RecordBatch.from_arrays([pa.array(v[fits]) for v in out], _PAIR)

    return labelled.repartition("gram").sortWithinPartitions("gram").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in _PAIR))


def _labelled(entries: DataFrame, label: DataFrame) -> DataFrame:
    """Entries with the component of their row; a row without links is one of its own."""
    return entries.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).select("gram", *_ENTRY[1:], "component")


_HUB = ("node", "n", "last", "alone", "alone_last")


def _hubs(wide: DataFrame) -> DataFrame:
    """(gram, hub): the row of fewest lone n-grams of each column."""
    return wide.groupBy("gram").agg(F.min(F.struct("alone", "n", "node", "last", "alone_last")).alias("hub"))


def _largest(labelled: DataFrame, turn: int) -> DataFrame:
    """(gram, size, members, component, hub): the largest component of each column, and a row of it that differs from turn to turn."""
    parts = labelled.groupBy("gram", "component").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), *_HUB)).alias("hub"))
    largest = F.max(F.struct("members", "component", "hub")).alias("largest")
    return parts.groupBy("gram").agg(F.sum("members").alias("size"), largest).select("gram", "size", "largest.members", "largest.component", "largest.hub")


def _stars(entries: DataFrame, hubs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of the hub of each column with its other rows that may link."""
    x = hubs.select("gram", *[F.col(f"hub.{c}").alias(f"{c}_x") for c in _HUB])
    y = entries.select("gram", *[F.col(c).alias(f"{c}_y") for c in _HUB])
    return y.join(x, "gram").where((F.col("node_x") != F.col("node_y")) & _possible(threshold)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _block_links(labelled: DataFrame, columns: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) of rows outside the largest component of a column with its other rows, by full overlaps.

    Columns with the same largest component are one group.  Blocks of BLOCK rows of a
    group meet, and their product is accumulated inside one task: rows are sent once
    to each block that they meet, pairs never.  Of the links of a row in a block one
    for each component comes back.
    """
    group = columns.where("members < size").select("gram", F.col("component").alias("g"))
    nodes = written(labelled.join(group, "gram").select("g", "node", "component").distinct().withColumn("outside", F.col("component") != F.col("g")))
    size = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1))
    sizes = nodes.groupBy("g").agg(size(F.count("*")).alias("blocks"), size(F.count_if("outside")).alias("outer")).where("outer > 0")
    rows = nodes.join(sizes, "g")
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asking = rows.where("outside").select("g", own(F.col("outer")).alias("i"), every(F.col("blocks")).alias("j"), F.lit(1).alias("asks"), "node", "component")
    others = rows.select("g", every(F.col("outer")).alias("i"), own(F.col("blocks")).alias("j"), F.lit(0).alias("asks"), "node", "component")
    full = _full_sets(nodes.select(F.col("node").alias("id")).distinct(), docs, k).withColumnRenamed("id", "node")
    meets = asking.unionByName(others).join(full, "node").select("g", "i", "j", "asks", "node", "component", "grams")

    def multiply(batches):
        block, held, product = None, [], None
        for batch in batches:
            a, b = [], []
            for g, i, j, asks, node, component, grams in zip(*(batch.column(c).to_pylist() for c in range(6)), batch.column(6)):
                if block != (g, i, j):
                    block, held, product = (g, i, j), [], None
                one = np.frombuffer(grams.as_buffer(), U64)
                if not asks:
                    held.append((node, component, one.copy()))
                    continue
                if held:
                    product = product or _Block(held)
                    found = product.linked(node, component, one, threshold)
                    a += [node] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return meets.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "asks").mapInArrow(tidy(multiply), "a long, b long")


class _Block:
    """The columns of some rows (node, component, grams): one row's overlaps with all of them come from one pass over its n-grams."""

    def __init__(self, rows):
        self.nodes, self.components = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:2])
        self.sizes = np.array([len(x) for _, _, x in rows])
        grams = np.concatenate([x for _, _, x in rows])
        order = np.argsort(grams, kind="stable")
        self.grams, self.rows = grams[order], np.repeat(np.arange(len(rows)), self.sizes)[order]

    def linked(self, node: int, component: int, grams: np.ndarray, threshold: int) -> list[int]:
        lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        common = np.bincount(self.rows[at], minlength=len(self.nodes))
        link = (100 * common >= threshold * (len(grams) + self.sizes - common)) & (self.components != component) & (self.nodes != node)
        _, first = np.unique(self.components[link], return_index=True)
        return self.nodes[link][first].tolist()


def _need(threshold: int):
    """The least overlap with which rows of n_x and n_y entries link."""
    return F.ceil(F.lit(threshold) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + threshold) - 1e-9)


def _index_length(n: str, threshold: int):
    return F.col(n) - F.ceil(F.lit(2 * threshold) * F.col(n) / F.lit(100 + threshold) - 1e-9) + 1


def _full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, grams): the sorted n-grams of the rows in ids, and of some others that pass a Bloom filter."""
    inside, bits = sketch.members(ids)
    shared = docs.sparkSession.sparkContext.broadcast(inside)

    def sets(batches):
        for batch in batches:
            (own,) = sketch.number_keys(batch.select([0]))
            kept = batch.filter(pa.array(sketch.may_repeat(shared.value, own, bits)))
            at, out = [], []
            for i, own in _rows(kept.column(1), k):
                at.append(i)
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([kept.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], ["id", "grams"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(sets), "id long, grams binary")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link, by full overlaps.  Only rows in pairs are read into sets again.

    The set of a goes once to each block of its partners, the set of b to each a that
    it meets; an a with very many partners has its blocks in many tasks.
    """
    pairs = written(pairs)
    full = _full_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), docs, k)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("blocks"))
    dealt = pairs.join(many, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).drop("blocks")
    meets = dealt.select("a", "block", F.col("b").alias("id"), F.lit(1).alias("partner"))
    meets = meets.unionByName(dealt.select("a", "block", F.col("a").alias("id"), F.lit(0).alias("partner")).distinct())
    few = pairs.count() <= BROADCAST_PAIRS
    joined = full.join(F.broadcast(meets) if few else meets, "id").select("a", "block", "partner", "id", "grams")

    def multiply(batches):
        group, mine = None, []
        for batch in batches:
            a, b = [], []
            for key, block, partner, other, grams in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                own = np.frombuffer(grams.as_buffer(), U64)
                if group != (key, block):
                    group, mine = (key, block), []
                if not partner:
                    mine.append(own.copy())
                elif any(_similar(x, own, threshold) for x in mine):
                    a.append(key)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return joined.repartition("a", "block").sortWithinPartitions("a", "block", "partner").mapInArrow(tidy(multiply), "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= threshold * (len(x) + len(y) - common)


def linked(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs (doc_id, text).

    Two documents link if 100 * |intersection| >= threshold * |union| of their sets
    of k-word shingles, lower-cased (A-Z).  With fewer than k words the whole text
    is one shingle; without words (or text) a document links with nothing.  Rows
    that share a doc_id count as one document; rows with a null doc_id link with
    nothing and have a null component.  Repeated rows repeat.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = written(_sets(docs, k))
    sets = found.where("block is null").select("doc_id", "n", "k1", "k2")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(found.where("block is not null").select("block", "at", "counts")))
    live = sets.where("n > 0 and doc_id is not null")
    same = written(live.groupBy("k1", "k2", "n").agg(F.min("doc_id").cast("long").alias("node")))

    # the first product: prefixes only, each different row once
    first = written(_prefixes(docs.where("doc_id is not null"), same.select("node"), levels, k, threshold))
    entries = written(_entries(first, levels))
    dropped(first)

    # wide columns: multiply with one row of theirs, merge what links; again with another row while many pairs are left
    narrow, wide = _split(entries)
    links = [written(_verified(_stars(wide, _hubs(wide), threshold), docs, k, threshold))]
    label, before = written(components(links[0]).withColumnsRenamed({"id": "node"})), None
    for turn in range(1, TURNS + 1):
        joined = written(_labelled(wide, label))
        columns = written(_largest(joined, turn))
        load, rows = columns.agg(F.sum((F.col("size") - F.col("members")) * F.col("size")), F.sum("size")).first()
        if turn == TURNS or not load or load <= FEW_PAIRS * rows or (before is not None and load > 0.8 * before):
            break
        before = load
        outside = joined.join(columns.select("gram", F.col("component").alias("largest")), "gram").where(F.col("component") != F.col("largest"))
        links.append(written(_verified(_stars(outside, columns.select("gram", "hub"), threshold), docs, k, threshold)))
        dropped(joined, columns, label)
        label = written(components(reduce(DataFrame.unionByName, links)).withColumnsRenamed({"id": "node"}))

    # what is left of wide columns: blocks of rows outside their largest component against blocks of all their rows
    if load:
        links.append(written(_block_links(joined, columns, docs, k, threshold)))
    dropped(joined, columns)

    # narrow columns: pairs of rows of different components, the shorter row by its index prefix.  A pair that
    # shares a wide column too is in a block already, so the overlaps of all others are whole here.
    pairs = _narrow_pairs(_labelled(narrow, label), threshold)
    left, right = F.col("n_x") - _index_length("n_x", threshold), F.col("n_y") - F.col("p_y")
    rest = F.when(F.col("index_last_x") < F.col("last_y"), left).when(F.col("index_last_x") > F.col("last_y"), right).otherwise(F.greatest(left, right))
    pairs = pairs.groupBy(*_PAIR).agg(F.count("*").alias("overlap")).where(F.col("overlap") + rest >= _need(threshold))
    links.append(written(_verified(pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")), docs, k, threshold)))
    dropped(entries, wide, label)
    label = written(components(reduce(DataFrame.unionByName, links)))

    of_set = written(same.join(label.withColumnsRenamed({"id": "node"}), "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id")))
    dropped(same, label, *links)
    rest = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").cast("long").alias("component_id"))
    joined = live.join(of_set, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(rest)


def _possible(threshold: int):
    """The sizes of x and y allow the threshold, less lone n-grams that the other row cannot have.

    A lone n-gram of x is in no other prefix; where the prefix of y reaches beyond it
    in the order, it is not in the rest of y either.
    """
    most = lambda s, t: F.col(f"n_{s}") - F.when(F.col(f"alone_last_{s}") < F.col(f"last_{t}"), F.col(f"alone_{s}")).otherwise(0)
    return F.least(most("x", "y"), most("y", "x")) >= _need(threshold)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
