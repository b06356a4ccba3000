"""Substring dedup: drop words covered by a 20-word window that also starts earlier.

First pass: a count-min sketch.  A window is represented by its minimizer, the least
hash of the 8-word runs in it.  Equal windows have equal minimizers at equal places,
so a window that repeats has a minimizer that occurs twice or more; each task counts
the places that are minimizers of some window (about a sixth of all words) and
merged counters overestimate the count of any window: none that repeats is lost.
The counters have a fixed bound.  For a corpus with more minimizers than a sketch can
hold apart, the minimizers are written once, in slices by hash; each slice has a
sketch of its own, and the minimizers that pass go back to their texts.  So the
sketch never fills up, and texts are cut twice whatever the number of slices.

Second pass: only windows estimated to repeat are grouped, by minimizer and an
independent hash of all 20 words, 128 bits together.  Neighbouring windows with one
minimizer travel as one row.  A task groups its own stretch of windows at once:
repeats inside the stretch are decided there, and only the first of each key goes
on, so a window found in a third of all documents sends one row for each stretch,
not one for each document.

Exact copies of a whole text need no windows: every window of a later copy also
starts in the first one.  A sketch of text hashes finds texts that may have copies;
only their ids meet by checksum, and a Bloom filter of the first copies (which lets
a few later ones pass, and no first one be missed) tells which texts are cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .shared import bounded_batches, dropped, tidy, written
from .words import U64, Words, bytes_buffer, mix, runs_of, text_chunks

WINDOW = 20
#: Minimizers that a slice counts, at most (a quarter of the counters of a row).
SLICE_KEYS = 1 << (sketch.MAX_BITS - 2)
#: Windows estimated repeated that a task groups at once.
STRETCH = 1 << 19
_GRAM, _WHOLE = 0xAF251AF3B0F025B5, 0xD1342543DE82EF95


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every `width` consecutive entries, by doubling."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _chunks(column: pa.Array, k: int):
    """(first row, words, hashes of runs, minimizer of each window or 0 where a text has ended, runs in a window) by chunks."""
    run = max(1, k * 2 // 5)
    for lo, _, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        n = len(words.starts) - k + 1
        if n <= 0:
            continue
        ends = np.repeat(words.first[1:], np.diff(words.first))[:n]
        grams = mix(runs_of(words.hashes(), run, _GRAM)) | U64(1)
        mins = np.where(np.arange(n) + k <= ends, _slide(grams, k - run + 1, np.minimum), U64(0))
        yield lo, words, grams, mins, k - run + 1


def _minimizers(column: pa.Array, k: int):
    """(rows, keys) that the sketch counts: each place whose run is the minimizer of some window, once."""
    for lo, words, grams, mins, width in _chunks(column, k):
        most = _slide(np.pad(mins, width - 1), width, np.maximum)
        at = np.flatnonzero(grams == most)
        yield lo + np.searchsorted(words.first, at, "right") - 1, grams[at]


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mix(keys ^ U64(0xA0761D6478BD642F)) % U64(slices)).astype(np.int64)


def first_copies(docs: DataFrame) -> tuple:
    """(what _cut needs to leave out later copies of equal texts, later copies (doc, row)) for docs (doc, text, row, hash).

    Rows of the least doc of a text all count as first.
    """
    spark = docs.sparkSession
    keys = written(docs.select("doc", "row", "hash", F.unhex(F.md5("text")).alias("sum")))
    bits = sketch.bits_for(keys.count(), 8)
    often = spark.sparkContext.broadcast(sketch.repeated_cells(keys.select("hash"), sketch.number_keys, bits))

    def some(batches):
        for batch in batches:
            (own,) = sketch.number_keys(batch.select([2]))
            yield batch.filter(pa.array(sketch.may_repeat(often.value, own, bits)))

    shared = written(keys.mapInArrow(tidy(some), keys.schema))
    firsts = written(shared.groupBy("hash", "sum").agg(F.min("doc").alias("first"), F.count("*").alias("copies")))
    later = shared.join(firsts.where("copies > 1"), ["hash", "sum"]).where(F.col("doc") > F.col("first")).select("doc", "row").distinct()
    later, members = written(later), _broadcast_members(firsts.select("first"))
    dropped(keys, shared, firsts)
    return (often, bits, *members), later


def _broadcast_members(numbers: DataFrame) -> tuple:
    found, bits = sketch.members(numbers)
    return numbers.sparkSession.sparkContext.broadcast(found), bits


def _cut(copies: tuple, doc: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """Whether to cut the texts into windows; certainly for all but later copies."""
    often, bits, firsts, first_bits = copies
    single = ~sketch.may_repeat(often.value, mix(text_hash.view(U64)), bits)
    return single | sketch.may_repeat(firsts.value, mix(doc.view(U64)), first_bits)


def _segments(same: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of runs of n entries, where same tells whether an entry but the first continues a run."""
    begins = np.flatnonzero(np.r_[True, ~same]) if n else np.zeros(0, np.int64)
    return begins, np.diff(np.r_[begins, n])


def _later(key, window, doc, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, order, head): entries whose key and window an earlier place has too; head leads the group of each entry in order."""
    order = np.lexsort((start, doc, window, key))
    k, w = key[order], window[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    later = np.zeros(len(doc), bool)
    later[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    return later, order, head


def _covered(doc, row, start) -> pa.RecordBatch:
    """Rows (doc, row, start, n) of neighbouring starts."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    at, n = _segments((doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] - start[:-1] <= 1), len(doc))
    last = at + n - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(row[at]), pa.array(start[at]), pa.array((start[last] - start[at] + 1).astype(np.int32))], ["doc", "row", "start", "n"])


def _candidates(docs: DataFrame, select, k: int) -> DataFrame:
    """(key, doc, row, start, n, windows) for docs (doc, text, row, ...): n neighbouring windows of one minimizer that may repeat.

    select(batch) gives the rows to cut and a function of minimizers and their rows
    that tells which may repeat.  Windows that the task has decided to be later ones
    come without hashes and with any key.
    """
    names = ["key", "doc", "row", "start", "n", "windows"]

    def run(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            batch, may_repeat = select(batch)
            docs_of, rows_of = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for lo, words, _, mins, _ in _chunks(batch.column(1), k):
                at = np.flatnonzero(mins)
                if not len(at):
                    continue
                begins, lengths = _segments(mins[at[1:]] == mins[at[:-1]], len(at))
                keep = may_repeat(mins[at[begins]], lo + np.searchsorted(words.first, at[begins], "right") - 1)
                at = at[np.repeat(keep, lengths)]
                if not len(at):
                    continue
                windows = mix(runs_of(words.hashes(1), k, _WHOLE)[at])
                owner = np.searchsorted(words.first, at, "right") - 1
                held.append((mins[at].view(np.int64), windows.view(np.int64), docs_of[lo + owner], rows_of[lo + owner], (at - words.first[owner]).astype(np.int32)))
                n += len(at)
                if n >= STRETCH:
                    yield from decided(held)
                    held, n = [], 0
        if n:
            yield from decided(held)

    def decided(held):
        key, window, doc, row, start = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        later, _, _ = _later(key, window, doc, start)
        if later.any():
            found = _covered(doc[later], row[later], start[later])
            own = mix(np.asarray(found.column(0)).view(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), *found.columns, pa.nulls(found.num_rows, pa.binary())], names)
        key, window, doc, row, start = (x[~later] for x in (key, window, doc, row, start))
        same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1)
        at, n = _segments(same, len(key))
        made = pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (key, doc, row, start)), pa.array(n.astype(np.int32)), _binaries(window, at)], names)
        for a in range(0, made.num_rows, 1 << 15):
            yield made.slice(a, 1 << 15)

    return docs.mapInArrow(tidy(run), "key long, doc long, row long, start int, n int, windows binary")


def _grouped(found: DataFrame) -> DataFrame:
    """(doc, row, start, n): starts that an earlier place has too, for candidates as _candidates gives them.

    Rows come sorted by key and doc and are worked on as they come.  What is kept of
    earlier ones are the windows of the last key, each once.
    """

    def run(batches):
        held, carry = None, (None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            decided = pc.is_null(batch.column(5))
            if decided.true_count:
                yield batch.filter(decided).select([1, 2, 3, 4])
            batch = batch.filter(pc.invert(decided))
            if held is not None and held.num_rows:
                batch = pa.concat_batches([held, batch])
            key, doc = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            # rows of the last key and doc wait, for more of them may come
            whole = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[-1]) if len(key) else 0
            if whole:
                out, carry = judged(batch.slice(0, whole), carry)
                yield out
            held = batch.slice(whole)
        if held is not None and held.num_rows:
            yield judged(held, carry)[0]

    def judged(batch, carry):
        n = np.asarray(batch.column(4))
        of = np.repeat(np.arange(len(n)), n)
        key, doc, row, start = (np.asarray(batch.column(c))[of] for c in range(4))
        start = (start + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        data, offsets = bytes_buffer(batch.column(5))
        window = data[offsets[0] : offsets[-1]].view(np.int64)
        later, _, head = _later(key, window, doc, start)
        last, seen, seen_doc, seen_start = carry
        if last == key[0] and len(seen):
            mine = np.flatnonzero(key == last)
            at = np.minimum(np.searchsorted(seen, window[mine]), len(seen) - 1)
            later[mine] |= (seen[at] == window[mine]) & ((seen_doc[at] != doc[mine]) | (seen_start[at] != start[mine]))
        if last != key[-1]:
            seen, seen_doc, seen_start = seen[:0], seen_doc[:0], seen_start[:0]
        heads = np.unique(head[key[head] == key[-1]])
        heads = heads[~np.isin(window[heads], seen)]
        seen, seen_doc, seen_start = np.r_[seen, window[heads]], np.r_[seen_doc, doc[heads]], np.r_[seen_start, start[heads]]
        order = np.argsort(seen)
        return _covered(doc[later], row[later], start[later]), (key[-1], seen[order], seen_doc[order], seen_start[order])

    return found.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(tidy(run), "doc long, row long, start int, n int")


def repeated_starts(docs: DataFrame, copies: tuple, chars: int, k: int = WINDOW) -> DataFrame:
    """(doc, row, start, n): n neighbouring windows of docs (doc, text, row, hash) whose words also start earlier.

    Earlier means a smaller doc, or the same one and an earlier word.  `chars`, the
    length of all texts, sets the size of the sketch.
    """
    spark = docs.sparkSession
    keys = chars // 32  # words of some six characters, a sixth of them minimizers
    slices = 1 + keys // SLICE_KEYS
    bits = sketch.bits_for(keys // slices, 4)
    if slices > 1:
        return written(_grouped(_sliced_candidates(docs, copies, slices, bits, k)))

    def counted(batch):
        keep = _cut(copies, np.asarray(batch.column(0)), np.asarray(batch.column(2)))
        return (own for _, own in _minimizers(batch.column(1).filter(pa.array(keep)), k))

    often = spark.sparkContext.broadcast(sketch.repeated_cells(docs.select("doc", "text", "hash"), counted, bits))

    def select(batch):
        keep = _cut(copies, np.asarray(batch.column(0)), np.asarray(batch.column(3)))
        return batch.filter(pa.array(keep)), lambda heads, rows: sketch.may_repeat(often.value, heads, bits)

    return written(_grouped(_candidates(docs.select("doc", "text", "row", "hash"), select, k)))


def _sliced_candidates(docs: DataFrame, copies: tuple, slices: int, bits: int, k: int) -> DataFrame:
    """As _candidates, with the minimizers of all texts written once and counted slice by slice."""
    spark = docs.sparkSession

    def places(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_cut(copies, np.asarray(batch.column(0)), np.asarray(batch.column(3)))))
            for rows, own in _minimizers(batch.column(1), k):
                of = _slice_of(own, slices)
                order = np.lexsort((of, rows))
                rows, of, own = rows[order], of[order], own[order]
                at, _ = _segments((rows[1:] == rows[:-1]) & (of[1:] == of[:-1]), len(own))
                owner = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(of[at].astype(np.int32)), batch.column(0).take(owner), batch.column(2).take(owner), _binaries(own, at)], ["slice", "doc", "row", "keys"])

    table = docs.select("doc", "text", "row", "hash").mapInArrow(tidy(places), "slice int, doc long, row long, keys binary")
    table = written(table.repartition("slice", F.pmod(F.xxhash64("doc"), F.lit(32))), "slice")
    passed = []
    for number in range(slices):
        part = table.where(F.col("slice") == number)
        often = spark.sparkContext.broadcast(sketch.repeated_cells(part.select("keys"), lambda batch: iter([_keys_of(batch.column(0))[1]]), bits))

        def may_repeat(batches, often=often):
            for batch in batches:
                rows, own = _keys_of(batch.column(2))
                keep = sketch.may_repeat(often.value, own, bits)
                rows, own = rows[keep], own[keep]
                at, _ = _segments(rows[1:] == rows[:-1], len(own))
                owner = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), _binaries(own, at)], ["doc", "row", "keys"])

        passed.append(written(part.select("doc", "row", "keys").mapInArrow(tidy(may_repeat), "doc long, row long, keys binary")))
        often.unpersist()
    dropped(table)
    every = passed[0]
    for part in passed[1:]:
        every = every.unionByName(part)
    every = written(every.groupBy("doc", "row").agg(F.collect_list("keys").alias("keys")))
    dropped(*passed)
    holding, holding_bits = _broadcast_members(every.select("doc"))

    def holders(batches):
        for batch in batches:
            (own,) = sketch.number_keys(batch.select([0]))
            yield batch.filter(pa.array(sketch.may_repeat(holding.value, own, holding_bits)))

    texts = docs.select("doc", "text", "row").mapInArrow(tidy(holders), "doc long, text string, row long")

    def select(batch):
        lists = batch.column(3)
        entry, own = _keys_of(lists.flatten())
        known = np.sort(_in_row(own, np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())[entry]))

        def among(heads, rows):
            wanted = _in_row(heads, rows)
            return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted

        return batch, among

    return _candidates(texts.join(every, ["doc", "row"]).select("doc", "text", "row", "keys"), select, k)


def _in_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One number for a key and the row it belongs to."""
    return mix(keys ^ mix(rows.astype(U64)))


def _binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """8-byte values as one binary for each run that begins at `begins`."""
    edges = (np.r_[begins, len(values)] * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(values.tobytes())])


def _keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entry, key) of all keys in a column of binaries."""
    data, offsets = bytes_buffer(column)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), U64)


def deduplicated(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, for docs (doc_id, text).

    Null text: no words.  A null doc_id comes before all others.  Rows that share a
    doc_id are one place in the order: no start is earlier than an equal one, so
    exactly repeated rows keep what they hold alone.  Texts of fewer than k words
    stay whole.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), least).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.agg(F.count("*").alias("n"), F.count_distinct("doc").alias("d"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    # the doc tells rows apart; only where it repeats is the text's hash needed too
    keyed = keyed.withColumn("row", F.xxhash64("text") if rows["n"] > rows["d"] else F.lit(0).cast("long"))
    hashed = keyed.select("doc", "text", "row", F.xxhash64("text").alias("hash"))
    copies, later = first_copies(hashed)
    starts = repeated_starts(hashed, copies, rows["chars"], k).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    gone = later.withColumn("whole", F.lit(True)).join(starts, ["doc", "row"], "full").select("doc", "row", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    gone = written(gone)
    dropped(later)
    # only texts that may lose words meet the words they lose; the others stay where they are
    losing, losing_bits = _broadcast_members(gone.select("doc"))

    def digest(doc_id, texts, starts, whole):
        count, removed, sums = [], [], []
        for text, own, copy in zip(texts, starts, whole):
            words = kept = text.as_py().encode().split()
            if copy.as_py() and len(words) >= k:
                kept = []
            elif own.is_valid:
                at, n = (np.asarray(own.values.field(c)) for c in ("start", "n"))
                steps = np.zeros(len(words) + 1, np.int32)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + n - 1 + k, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
            count.append(len(words))
            removed.append(len(words) - len(kept))
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([doc_id, pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    def may_lose(batch):
        (own,) = sketch.number_keys(batch.select([1]))
        return sketch.may_repeat(losing.value, own, losing_bits)

    def whole_texts(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~may_lose(batch)))
            yield digest(batch.column(0), batch.column(2), pa.nulls(batch.num_rows), pa.nulls(batch.num_rows))

    def others(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_lose(batch)))

    def cut_texts(batches):
        for batch in batches:
            yield digest(*batch.columns)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    cut = keyed.mapInArrow(tidy(others), keyed.schema).join(gone, ["doc", "row"], "left").select("doc_id", "text", "starts", "whole")
    return keyed.select("doc_id", "doc", "text").mapInArrow(tidy(whole_texts), schema).unionByName(cut.mapInArrow(tidy(cut_texts), schema))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of windows that start earlier elsewhere."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
