"""What the operators of this package share: the shared folder, word rules, text batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import written
from quire.sources.tables import read_table

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that numpy work holds at once in a Python worker.
SLICE_BYTES = 4 << 20
#: Bytes of a batch that goes to a Python worker, about: it is held by the executor, by the worker, and once more while it is copied.
BATCH_BYTES = 4 << 20


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, and a lost executor loses nothing. Lowers the session's batches to Python workers to BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return written(df, name, compression)


def unused(docs: DataFrame, n: int) -> list[str]:
    """n names of columns that docs doesn't have, for use beside its own."""
    taken = {c.lower() for c in docs.columns}
    names = (f"own_{i}" for i in range(n + len(taken)))
    return [name for name in names if name not in taken][:n]


#: A table of at most so many short rows (ids and keys, some 32 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it, if a count shows that it is small; df should be stored."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches cut to at most `most` bytes of text (one longer text stands alone), with the texts as bytes; null is empty."""
    for batch in batches:
        own = batch.column(column).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(own), 0).to_pylist()
        cuts, held = [0], 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                cuts.append(i)
                held = 0
            held += n
        for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            if b > a:
                yield batch.slice(a, b - a), [x or b"" for x in own.slice(a, b - a).to_pylist()]


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which a Python worker gives back what it no longer uses: it may stand idle for long beside tasks that need the memory."""

    @wraps(run)
    def through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")
