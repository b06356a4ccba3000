"""Byte-level BPE: encode texts to token ids and decode ids to raw bytes, with the tiktoken library.

The rank file is read once on the driver and broadcast (its size is that of the
vocabulary, not of the data).  Long texts are cut before encoding, only where no
pattern match can span the cut, so ids equal those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from .shared import bounded_batches, tidy

# Unicode White_Space, which is what \s means to the pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_EDGE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_LONG_SPACE = re.compile(f"[{_SPACE}]{{4096,}}")
_ONLY_SPACE = re.compile(f"[{_SPACE}]+")

#: Texts longer than this many characters are cut at safe boundaries.
SPLIT_CHARS = 1 << 16
#: A broadcast rank file may not be larger.
MAX_RANK_BYTES = 64 << 20


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and decimal rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """Cut text so that every match of the pattern lies in one piece.

    A white-space character that follows a non-space always begins a match: only
    the optional leading space of a match is white space followed by non-space.
    So each change from non-space to space is a safe cut.  A stretch of `size`
    characters without one (a single giant word or run) stays whole.  Runs of
    4096 or more spaces inside a text are cut before their last character, as the
    pattern leaves exactly that one to what follows; a run at the end is one match.
    """
    if len(text) <= size and not _LONG_SPACE.search(text):
        yield text
        return
    at = 0
    while at < len(text):
        run = _LONG_SPACE.match(text, at)
        if run:
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield text[at:end]
            at = end
            continue
        run = _LONG_SPACE.search(text, at, min(len(text), at + size + 4096))
        if run:
            stop = run.start()
        elif len(text) - at <= size:
            stop = len(text)
        else:
            edge = _EDGE.search(text, at + size)
            stop = edge.start() if edge else len(text)
            run = _LONG_SPACE.search(text, at, stop)
            stop = run.start() if run else stop
        yield text[at:stop]
        at = stop


class Codec:
    """One vocabulary: text to ids and ids to bytes, without special tokens."""

    def __init__(self, rank_data: bytes, pattern: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(rank_data), special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; long runs of spaces bypass the pattern, whose backtracking is bounded."""
        if len(text) <= 4096:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in safe_pieces(text):
            if len(piece) >= 4096 - 1 and _ONLY_SPACE.fullmatch(piece):
                ids += self.encoding._encode_single_piece(piece)
            else:
                ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_codecs: dict[tuple, Codec] = {}


def _codec(rank_data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(rank_data).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_data, pattern)
    return _codecs[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file has over {MAX_RANK_BYTES} bytes")
    return data


def encode(df: DataFrame, rank_data: bytes, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with a column of token ids (array<int>).  Null text: empty array.  A column named `ids` is replaced."""
    return _mapped(df, rank_data, pattern, text, ids, ArrayType(IntegerType()), pa.list_(pa.int32()), lambda c, column: [c.encode(x or "") for x in column.to_pylist()])


def decode(df: DataFrame, rank_data: bytes, pattern: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """df with the raw bytes of an array of ids (binary): ids may end inside a character.  Null ids: empty."""
    return _mapped(df, rank_data, pattern, ids, data, BinaryType(), pa.binary(), lambda c, column: [c.decode(x or []) for x in column.to_pylist()])


def _mapped(df, rank_data, pattern, source, target, spark_type, kind, f) -> DataFrame:
    bounded_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(rank_data)
    keep = [c for c in df.columns if c.lower() != target.lower() or c == source]
    own = [x for x in df.schema.fields if x.name.lower() != target.lower()]
    schema = StructType([*own, StructField(target, spark_type)])
    names = [x.name for x in own]

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            done = pa.array(f(codec, batch.column(batch.schema.names.index(source))), kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), done], [*names, target])

    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(tidy(run), schema)


def round_trips(df: DataFrame, rank_data: bytes, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with token_ids and round_trip: does decoding the ids give back the text's bytes?

    Both ways in one worker, row by row.  Null or empty text: no tokens.
    """
    bounded_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(rank_data)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, StructField("token_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    place = len(kept)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            coded, same = [], []
            for value in batch.column(place):
                whole = value.as_py() or ""
                ids = codec.encode(whole)
                same.append(codec.decode(ids) == whole.encode())
                coded.append(np.array(ids, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(coded, pa.list_(pa.int32())), pa.array(same, pa.bool_())], schema.names)

    return df.select(*[f"`{f.name}`" for f in kept], text).mapInArrow(tidy(run), schema)


def digests(df: DataFrame, rank_data: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes.

    Encodes, then decodes the ids, row by row, so ids of a row are never kept
    beyond it.  Null or empty text: no tokens.  Repeated rows give repeated
    results; an empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(rank_data)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            count, coded, decoded = [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                count.append(len(ids))
                coded.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents by the multilingual 50k ranks."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
