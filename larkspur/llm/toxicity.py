"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees word features and
the log odds that the earlier models give.  While training, those odds come from
out-of-fold predictions, so a later model learns from errors like those it will
meet.  Features are the presence of hashed words and word beginnings, so that
inflected forms of one stem share evidence.

Models are fitted on the driver on a bounded sample of labelled rows (SAMPLE per
class, chosen by hash of the id); scoring covers every row and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import bounded_batches, tidy
from .words import U64, Words, mix, text_chunks

#: Labelled rows of either class that the models are fitted on, at most.
SAMPLE = 3000
#: Word features of each category, at most.
FEATURES = 4096
#: Labelled rows that must hold a feature, at least.
LEAST = 3
#: Parts of the features that are counted one after the other.
_PARTS = 16
FOLDS = 5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
#: (category, condition on the labels), in the order of the chain.
CHAIN = (
    ("unwelcome", "toxic = 1 or quality = 0"),
    ("toxic", "toxic = 1"),
    ("toxic_junk", "toxic = 1 and quality = 0"),
)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words (whole, and first 4, 5 and 6 bytes) and the text of each."""
    words = Words(data, offsets, lower=True)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out, of, head = [words.hashes()], [owner], words.part(slice(None))
    for n in PREFIXES:
        long = words.lengths >= n
        out.append(mix(head[long] & U64((1 << 8 * n) - 1) ^ U64(n << 56)))
        of.append(owner[long])
    return np.concatenate(out), np.concatenate(of)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class _Rows:
    """Presence of numbered features in rows, as sorted (row, feature) pairs, and dense columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, width: int, dense: np.ndarray):
        self.row, self.col, self.n, self.width, self.dense = row, col, n, width, dense

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[: self.width][self.col], self.n) + self.dense @ w[self.width :]

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.col, g[self.row], self.width), self.dense.T @ g]

    def some(self, keep: np.ndarray) -> _Rows:
        number = np.cumsum(keep) - 1
        inside = keep[self.row]
        return _Rows(number[self.row[inside]], self.col[inside], int(keep.sum()), self.width, self.dense[keep])


def fit(x: _Rows, y: np.ndarray, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by accelerated gradient descent with a ridge penalty; the last weight is the intercept's."""
    w = v = np.zeros(x.width + x.dense.shape[1])
    mean = max(1.0, np.bincount(x.row, minlength=max(x.n, 1)).mean() + (x.dense**2).sum(1).mean()) if x.n else 1.0
    rate = 4.0 / mean
    for k in range(steps):
        g = x.gradient(_sigmoid(x.scores(v)) - y) / max(x.n, 1) + decay * v
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Chain:
    """The fitted models: sorted feature hashes, and weights of each category."""

    known: np.ndarray
    weights: list[np.ndarray]
    names: tuple[str, ...]
    shift: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probabilities of all categories for each text."""
        out = np.zeros((len(column), len(self.weights)))
        mask = U64((1 << 20) - 1)
        table = np.zeros(1 << 20, bool)
        table[(self.known & mask).astype(np.int64)] = True
        for lo, hi, data, offsets in text_chunks(column):
            found, owner = features(data, offsets)
            maybe = np.flatnonzero(table[(found & mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, found[maybe]), max(len(self.known) - 1, 0))
            hit = self.known[at] == found[maybe] if len(self.known) else np.zeros(0, bool)
            pairs = np.unique(owner[maybe][hit] * len(self.known) + at[hit])
            n = hi - lo
            dense = np.ones((n, 1))
            for k, w in enumerate(self.weights):
                x = _Rows(pairs // max(len(self.known), 1), pairs % max(len(self.known), 1), n, len(self.known), dense)
                p = _sigmoid(x.scores(w) + self.shift)
                out[lo:hi, k] = p
                dense = np.c_[_logit(p), dense]
        return out


def _telling(every: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The features whose share differs most between the labels of a category, sorted; worked out part by part, which bounds memory."""
    values, scores = [], []
    for part in range(_PARTS):
        own = np.flatnonzero(every % U64(_PARTS) == U64(part))
        v, of = np.unique(every[own], return_inverse=True)
        total = np.bincount(of, minlength=len(v))
        z = np.zeros((labels.shape[1], len(v)))
        for k, y in enumerate(labels.T):
            yes, n1 = np.bincount(of, y[owner[own]], len(v)), y.sum()
            n0 = len(y) - n1
            if n1 and n0:
                share = total / len(y)
                z[k] = (yes / n1 - (total - yes) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        z[:, total < LEAST] = 0
        some = (np.abs(z) >= 4).any(0)
        values.append(v[some])
        scores.append(z[:, some])
    values, scores = np.concatenate(values), np.concatenate(scores, 1)
    order = np.argsort(values)
    values, scores = values[order], np.abs(scores[:, order])
    chosen = np.zeros(len(values), bool)
    for z in scores:
        good = np.flatnonzero(z >= 4)
        chosen[good[np.argsort(-z[good], kind="stable")[:FEATURES]]] = True
    return values[chosen]


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], shift: float = 0.0, names=tuple(n for n, _ in CHAIN)) -> Chain:
    """Fit the chain on (feature hashes, category labels) of the sample.

    Features are those whose share differs most between the labels of a category, by
    a two-proportion z score of 4 or more.  `shift` corrects the intercepts for the
    share of the classes in the sample.
    """
    labels = np.array([y for _, y in rows], float)
    every = np.concatenate([x for x, _ in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x, _ in rows])
    known = _telling(every, owner, labels)
    row, col = [], []
    for a in range(0, len(every) if len(known) else 0, 1 << 20):
        some = every[a : a + (1 << 20)]
        at = np.minimum(np.searchsorted(known, some), len(known) - 1)
        hit = known[at] == some
        row.append(owner[a : a + (1 << 20)][hit])
        col.append(at[hit])
    del every, owner
    row, col = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, col))
    width = len(known)
    fold = np.arange(len(rows)) % FOLDS
    dense, weights = np.ones((len(rows), 1)), []
    for k in range(labels.shape[1]):
        x, y = _Rows(row, col, len(rows), width, dense), labels[:, k]
        weights.append(fit(x, y))
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            w = fit(x.some(fold != f), y[fold != f])
            unseen[fold == f] = _sigmoid(x.some(fold == f).scores(w) + shift)
        dense = np.c_[_logit(unseen), dense]
    return Chain(known, weights, tuple(names), shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """A chain from labelled documents; None where labels lack toxic or other rows.

    Several labels of a document: toxic if any says so, low quality if any says so.
    Rows with a null id or label do not count.
    """
    bounded_batches(docs.sparkSession)
    agreed = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    counts = {r["toxic"]: r["count"] for r in agreed.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    order = F.xxhash64("doc_id")
    chosen = agreed.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(agreed.where("toxic <> 1").orderBy(order, "doc_id").limit(sample))
    chosen = chosen.select("doc_id", F.array(*[F.expr(f"cast({test} as int)") for _, test in CHAIN]).alias("y"))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows

    def run(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                found, owner = features(data, offsets)
                order = np.argsort(owner, kind="stable")
                edges = np.searchsorted(owner[order], np.arange(hi - lo + 1))
                out += [np.unique(found[order[edges[i] : edges[i + 1]]]).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = joined.select("doc_id", "text", "y").mapInArrow(tidy(run), f"doc_id {kind}, y array<int>, x binary").collect()
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]), bytes(r["x"])))  # folds are dealt alike in every process
    if not any(r["y"][1] for r in rows) or all(r["y"][1] for r in rows):
        return None
    # the intercept of a sample with other class shares than the labels'
    toxic = sum(r["y"][1] for r in rows)
    seen = {1: toxic, 0: len(rows) - toxic}
    shift = float(np.log(counts[1] / counts[0]) - np.log(seen[1] / seen[0]))
    return fit_chain([(np.frombuffer(r["x"], U64), r["y"]) for r in rows], shift)


def score(docs: DataFrame, chain: Chain | None, text: str = "text", keep=None) -> DataFrame:
    """docs with a column p_<category> for each category, replacing columns of these names.

    keep: None for all rows, True for toxic rows only, False for the others.
    Null and empty texts have no features.  Without a chain all probabilities are 0.
    """
    bounded_batches(docs.sparkSession)
    names = [n for n, _ in CHAIN]
    own = [c for c in docs.columns if c.lower() not in {f"p_{n}" for n in names}]
    base = docs.select(*[f"`{c}`" for c in own])
    schema = StructType([*base.schema.fields, *(StructField(f"p_{n}", DoubleType()) for n in names)])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            p = model.scores(column) if model else np.zeros((batch.num_rows, len(names)))
            made = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names)))], [*own, *(f"p_{n}" for n in names)])
            yield made if keep is None else made.filter(pa.array((p[:, 1] >= THRESHOLD) == keep))

    return base.mapInArrow(tidy(run), schema)


def rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxic documents: doc_id, toxic (true) and the probability of each category.

    Documents without words are never toxic; repeated rows repeat; an empty table
    gives an empty result; other columns are not read.
    """
    chain = train(docs, labels)
    return score(docs.select("doc_id", "text"), chain, keep=True).select("doc_id", F.lit(True).alias("toxic"), *[F.round(f"p_{n}", 6).alias(f"p_{n}") for n, _ in CHAIN])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic ones among all documents, by models trained on their labels."""
    return rejected(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
