"""What the operators share: batches of bounded size, tables cut from their lineage, table reading."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.storage import discard, settle as cut, shared_dir  # noqa: F401

#: Bytes of text that a Python operator takes at a time, unless a single text is longer.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `limit` bytes in `column`, of one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        off = memoryview(col.buffers()[1]).cast("q" if wide else "i")[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < batch.num_rows:
            stop = at + 1
            while stop < batch.num_rows and stop - at < PIECE_ROWS and off[stop + 1] - off[at] <= limit:
                stop += 1
            yield batch.slice(at, stop - at)
            at = stop


#: Arrow batches between the JVM and Python hold so many bytes at most; Spark's default suits narrow rows only.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow(fn, schema) with batches of bounded bytes: the session's limit is lowered, never raised."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:  # a limit with a unit is set anew
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(_released(batches))
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back: workers are kept for later tasks, and would hold what their largest one took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        del batch
        release()


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, column: str = "text") -> DataFrame:
    """fn over slices of bounded size of df's batches; narrow, so a lost task is run again alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            yield fn(piece)

    return map_arrow(df, run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, for columns that an operator needs meanwhile."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows with different ids or texts apart; a null text is like an empty one."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.col(id_col).isNull().cast("string"), F.length(ident).cast("string"), F.lit(":"), ident, F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def fits(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows, found without counting more than that."""
    return df.limit(most + 1).count() <= most


def sample_per_class(df: DataFrame, label: str, per_class: int, key: str, classes: int = 2000, seed: int = 7) -> DataFrame:
    """About per_class rows of each label, drawn by a hash of `key`: the bounded sample that a classifier is fitted on.

    Of more than `classes` labels, those with the most rows. The class counts are over all rows.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(classes).collect()
    share = F.lit(0.0)
    if counts:
        table = F.create_map(*[F.lit(x) for row in counts for x in (row[0], min(1.0, per_class / row["count"]))])
        share = F.coalesce(F.try_element_at(table, F.col(label)), F.lit(0.0))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return df.filter(F.col(label).isNotNull() & (u < share))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
