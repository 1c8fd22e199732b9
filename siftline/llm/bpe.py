"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read where the tokens are made, on each executor, from a path that is a parameter.
Texts over SPLIT_CHARS are cut at safe boundaries first, so that neither the library's regular
expression nor its merges ever see an unbounded string:

* before white space that follows a character that isn't white space: no match of the pattern goes on there;
* where a letter meets a digit: no match has both.

Matches left and right of such a place are those of the whole text. A stretch without one (a single
word, or white space, of millions of characters) is split by the same pattern in another library and
each match is merged alone, which gives the same ids.

Defined results: a null text is an empty one and has no ids; repeated rows repeat their results; an
empty table gives an empty one; columns of the input whose names clash with the outputs are replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import map_arrow, map_texts

SPLIT_CHARS = 1 << 16
#: A stretch without a safe boundary goes to the library's own regular expression up to this length.
WHOLE_CHARS = 1 << 17
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


class Codec:
    """Encodes and decodes with one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        if len(text) <= SPLIT_CHARS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text):
            if len(part) <= WHOLE_CHARS:
                ids += self.encoding.encode_ordinary(part)
            else:
                for match in self.pattern.finditer(part):
                    ids += self.encoding._encode_single_piece(match[0])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def safe_parts(text: str, size: int = SPLIT_CHARS):
    """The text in parts of about `size` characters that end at safe boundaries (longer where there is none)."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found or found.start() >= len(text):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """df with the token ids of each whole text in `ids_col`."""
    keep = [f for f in df.schema.fields if f.name != ids_col]
    out = T.StructType([*keep, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = codec(path, pattern)
        ids = pa.array([made.encode(t or "") for t in batch.column(text_col).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), ids], names=out.names)

    return map_texts(df, run, out, text_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids in `ids_col` stand for in `bytes_col`; bytes needn't be whole characters."""
    keep = [f for f in df.schema.fields if f.name != bytes_col]
    out = T.StructType([*keep, T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batches):
        made = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                raw = pa.array([made.decode(x or []) for x in part.column(ids_col).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), raw], names=out.names)

    return map_arrow(df, run, out)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass: the ids don't cross to the JVM and back, and a task has one Python worker."""
    keep = [f for f in df.schema.fields if f.name not in (ids_col, bytes_col)]
    out = T.StructType([*keep, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = codec(path, pattern)
        ids = [made.encode(t or "") for t in batch.column(text_col).to_pylist()]
        raw = pa.array(map(made.decode, ids), pa.binary(), size=len(ids))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(ids, pa.list_(pa.int32())), raw], names=out.names)

    return map_texts(df, run, out, text_col)


def digest(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """doc_id with the number of ids, and the SHA-256 of the ids in decimal and of the decoded bytes."""
    return df.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(bytes_col), 256).alias("decoded_sha256"),
    )
