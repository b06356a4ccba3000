"""Benchmark decontamination: SimHash of item-sized windows, Hamming search, exact check.

Texts are compared as lower-cased (A-Z) words in shingles of five.  A window has
as many words as an item.  Only windows that hold a shingle of an item of their
size get a fingerprint: all others have similarity 0 with every such item.
Fingerprints within the radius are found by blocks: with radius r and r+1 blocks,
two fingerprints at most r bits apart agree in one block at least.  Candidates are
then verified by weighted Jaccard similarity of shingle counts.

Items go to the executors in slices of bounded size; a larger benchmark takes
more passes over the documents.  Shingles weigh by their items in the whole
benchmark: each slice also has the counts of shingles that several items share,
16 bytes each; one of a single item weighs as much as one of none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, tidy, written
from .words import U64, mix, shingle_hashes, text_chunks, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
#: Expected distance at similarity 0.8 is 0.15 * 128 = 19.5, with a deviation of 4: three deviations above.
RADIUS = 32
#: Begins of windows, and shingles, that are turned into votes at once (8 MB).
STRETCH = 1 << 13
#: Characters of item text in one broadcast slice.
SLICE_CHARS = 16 << 20


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits that a shingle votes on."""
    two = np.stack([hashes, mix(hashes ^ U64(0x94D049BB133111EB))], 1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _short(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k < SHINGLE consecutive words, as shingle_hashes gives them to a text of k words."""
    n = len(words) - k + 1
    h = np.full(max(n, 0), k, U64)
    for j in range(k):
        h = h * U64(0xA0761D6478BD642F) + words[j : j + max(n, 0)]
    return mix(h ^ U64(0x5851F42D4C957F2D))


class Items:
    """A slice of benchmark items, ready to be searched."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY, radius: int = RADIUS, shared: tuple[int, np.ndarray, np.ndarray] | None = None):
        """shared: number of items, and shingles with their numbers of items where several have them; by default of this slice."""
        self.similarity, self.radius = similarity, radius
        column = pa.array(texts, pa.large_string())
        self.ids, self.sizes, self.shingles, self.counts = [], [], [], []
        at = 0
        for lo, hi, data, offsets in text_chunks(column):
            words, _, first = word_hashes(data, offsets, lower=True)
            shingles, pos = shingle_hashes(words, first, SHINGLE)
            for i in range(hi - lo):
                if first[i + 1] > first[i]:
                    own, n = np.unique(shingles[pos[i] : pos[i + 1]], return_counts=True)
                    self.ids.append(ids[lo + i])
                    self.sizes.append(int(first[i + 1] - first[i]))
                    self.shingles.append(own)
                    self.counts.append(n)
            at = hi
        self.sizes = np.array(self.sizes, np.int64)
        every = np.concatenate(self.shingles) if self.shingles else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.shingles])
        self.known, df = np.unique(every, return_counts=True)
        total, self.several, df = shared or (len(self.ids), self.known[df > 1], df[df > 1])
        self.common = float(np.log1p(total))
        self.weight = np.log1p(total / df) if len(df) else np.zeros(0)
        order = np.argsort(every, kind="stable")
        self.owners, self.owner_at = owner[order], np.searchsorted(every[order], self.known)
        self.owner_end = np.r_[self.owner_at[1:], len(order)].astype(np.int64) if len(self.known) else np.zeros(0, np.int64)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.known & U64((1 << 22) - 1)).astype(np.int64)] = True
        self.edges = np.linspace(0, BITS, radius + 2).astype(int)
        prints = np.stack([self._print(s, n) for s, n in zip(self.shingles, self.counts)]) if self.ids else np.zeros((0, BITS), bool)
        self.prints = prints
        self.by_size = {int(s): np.flatnonzero(self.sizes == s) for s in np.unique(self.sizes)}
        self.blocks = {s: self._index(prints[own]) for s, own in self.by_size.items()}
        self.short = [s for s in self.by_size if s < SHINGLE]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """Rarer shingles of the benchmark weigh more; those in no item weigh most."""
        if not len(self.several):
            return np.full(len(shingles), self.common)
        at = np.minimum(np.searchsorted(self.several, shingles), len(self.several) - 1)
        return np.where(self.several[at] == shingles, self.weight[at], self.common)

    def _print(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (_signs(shingles) * (self.weights(shingles) * counts)[:, None]).sum(0) > 0

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        part = prints[:, self.edges[b] : self.edges[b + 1]]
        return part @ (1 << np.arange(part.shape[1]))

    def _index(self, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for b in range(self.radius + 1):
            values = self._block(prints, b)
            order = np.argsort(values, kind="stable")
            out.append((values[order], order))
        return out

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All (row of prints, item) of a size within the radius."""
        own, found = self.by_size[size], []
        for b, (values, order) in enumerate(self.blocks[size]):
            wanted = self._block(prints, b)
            lo, hi = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = hi - lo
            rows = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            found.append(rows * len(own) + order[at])
        pairs = np.unique(np.concatenate(found))
        rows, items = pairs // len(own), own[pairs % len(own)]
        close = (prints[rows] != self.prints[items]).sum(1) <= self.radius
        return rows[close], items[close]

    def similar(self, shingles: np.ndarray, item: int) -> float:
        own, n = np.unique(shingles, return_counts=True)
        every = np.union1d(own, self.shingles[item])
        a, b, w = np.zeros(len(every)), np.zeros(len(every)), self.weights(every)
        a[np.searchsorted(every, own)] = n
        b[np.searchsorted(every, self.shingles[item])] = self.counts[item]
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        maybe = np.flatnonzero(self.table[(shingles & U64((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == shingles[maybe]]

    def search(self, words: np.ndarray, shingles: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item: (similarity, first word, words) of its best window in one text; of equally good ones the first."""
        best: dict[int, tuple[float, int, int]] = {}
        at = np.searchsorted(self.known, shingles[hits])
        touched = np.unique(np.concatenate([self.owners[self.owner_at[a] : self.owner_end[a]] for a in np.unique(at)])) if len(hits) else []
        for size in np.unique(self.sizes[touched]) if len(touched) else []:
            size = int(size)
            width = max(1, min(size, len(words)) - SHINGLE + 1)  # shingles of a window
            last = max(len(shingles) - width, 0)
            # the windows that hold a hit, as one mark for each begin of the text
            steps = np.zeros(last + 2, np.int32)
            np.add.at(steps, np.clip(hits - width + 1, 0, last), 1)
            np.add.at(steps, np.minimum(hits, last) + 1, -1)
            begins = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
            # stretches of bounded size; those with a wide gap between windows are cut there
            for some in np.split(begins, np.flatnonzero((np.diff(begins) > 4 * width) | (np.diff(begins // STRETCH) > 0)) + 1):
                self._verify(best, self._window_prints(shingles, some, width), some, size, width, shingles, len(words))
        for size in self.short:
            if len(words) < size:
                continue
            for begin in np.flatnonzero(np.isin(_short(words, size), self.known)):
                shingle = _short(words[begin : begin + size], size)
                for item in self.by_size[size]:
                    if self.shingles[item][0] == shingle[0] and item not in best:
                        best[int(item)] = (1.0, int(begin), size)
        return best

    def _window_prints(self, shingles: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of windows of `width` shingles: the first by its sum, the others by what enters and leaves."""

        def votes(lo: int, hi: int) -> np.ndarray:
            part = shingles[lo:hi]
            return _signs(part) * self.weights(part)[:, None]

        first, n = int(begins[0]), int(begins[-1] - begins[0])
        total = sum((votes(a, min(a + STRETCH, first + width)).sum(0) for a in range(first, first + width, STRETCH)), np.zeros(BITS))
        sums = np.zeros((n + 1, BITS))
        if n:
            np.cumsum(votes(first + width, first + width + n) - votes(first, first + n), axis=0, out=sums[1:])
        return total + sums[begins - first] > 1e-9

    def _verify(self, best, prints, begins, size, width, shingles, n_words) -> None:
        for row, item in zip(*self.near(prints, size), strict=True):
            begin, item = int(begins[row]), int(item)
            score = round(self.similar(shingles[begin : begin + width], item), 9)  # equal windows stay equal whatever the order of sums
            if score >= self.similarity and score > best.get(item, (0.0,))[0]:
                best[item] = (score, begin, min(size, n_words))


def _shared_shingles(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of items with words, sorted shingles that several items have, their numbers of items) of items (id, text)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                words, _, first = word_hashes(data, offsets, lower=True)
                shingles, pos = shingle_hashes(words, first, SHINGLE)
                own = [np.unique(shingles[pos[i] : pos[i + 1]]).view(np.int64) for i in range(hi - lo) if first[i + 1] > first[i]]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64()))], ["shingles"])

    sets = written(items.select("text").mapInArrow(tidy(run), "shingles array<long>"))
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    found = counts.toArrow()
    shingles, df = (np.asarray(found.column(c).combine_chunks()) for c in ("shingle", "df"))
    shingles = shingles.view(U64)
    order = np.argsort(shingles)
    return sets.count(), shingles[order], df[order]


def item_slices(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The benchmark in slices of about SLICE_CHARS characters; null and wordless items are left out."""
    items = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + chars // SLICE_CHARS
    shared = _shared_shingles(items) if count > 1 else None
    for k in range(count if chars else 0):
        rows = (items if count == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)).collect()
        yield Items([r["id"] for r in rows], [r["text"] for r in rows], shared=shared)


def _searched(items: Items, column: pa.Array) -> Iterator[tuple[int, dict]]:
    """(row, matches) of each text with a match."""
    for lo, _, data, offsets in text_chunks(column):
        words, _, first = word_hashes(data, offsets, lower=True)
        shingles, pos = shingle_hashes(words, first, SHINGLE)
        hits = items.hits(shingles)
        docs = set(np.unique(np.searchsorted(pos, hits, "right") - 1).tolist())
        if items.short:
            docs.update(range(len(first) - 1))
        for d in sorted(docs):
            own = hits[(hits >= pos[d]) & (hits < pos[d + 1])] if len(docs) < 64 else hits[np.searchsorted(hits, pos[d]) : np.searchsorted(hits, pos[d + 1])]
            found = items.search(words[first[d] : first[d + 1]], shingles[pos[d] : pos[d + 1]], own - pos[d])
            if found:
                yield lo + d, found


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and contained item: doc_id, item_id, start_word, n_words, similarity.

    The window given is the most similar one, of equal ones the first.  A document
    shorter than an item is one window.  Null or wordless texts and items match
    nothing; repeated documents and items repeat; an empty table on either side
    gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d, i = docs.schema[doc_id].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {d.simpleString()}, item_id {i.simpleString()}, start_word long, n_words long, similarity double"
    out = spark.createDataFrame([], schema)
    for k, part in enumerate(item_slices(items)):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            found = shared.value
            for batch in batches:
                rows, hits = [], []
                for row, best in _searched(found, batch.column(1)):
                    for item, hit in sorted(best.items()):
                        rows.append(row)
                        hits.append((found.ids[item], hit[1], hit[2], round(hit[0], 9)))
                if rows:
                    cols = list(zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cols[0], _arrow(i)), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)
        out = one if k == 0 else out.unionByName(one)
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that contain an item; all columns are kept as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for part in item_slices(items):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in _searched(shared.value, batch.column(batch.schema.names.index(text)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every whole text of documents."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
