"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.session import scratch_path

# Rows are handed on from Python in Arrow batches of about this many bytes,
# whatever the length of single texts.
OUT_BYTES = 8 << 20


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark):
    """The shuffle files of every query that is run inside go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage: a lost executor never re-runs what lies before it.
    """
    path = scratch_path(df.sparkSession, "llm", name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` has written for these frames; neither they nor frames made of them are read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark) -> None:
    """Send this package to the executors' Python (once per application), wherever the driver runs."""
    context = spark.sparkContext
    if not getattr(context, "_shiftlake_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(tempfile.mkdtemp(prefix="shiftlake-code-"), "shiftlake")
        context.addPyFile(shutil.make_archive(base, "zip", root, "shiftlake"))
        context._shiftlake_shipped = True


def release(owner: str) -> None:
    """Drop what the other operators of this subpackage keep in a Python worker (their caches).

    Workers serve one stage after the other, so in a pipeline the memos of
    every stage would add up. What is freed goes back to the system at once.
    """
    package, dropped = __name__.rpartition(".")[0] + ".", False
    for name, module in list(sys.modules.items()):
        if name.startswith(package) and name != owner:
            for cache in ("load", "load_table", "_matcher"):
                clear = getattr(getattr(module, cache, None), "cache_clear", None)
                if clear and getattr(module, cache).cache_info().currsize:
                    clear()
                    dropped = True
    if dropped:
        give_back()


def give_back() -> None:
    """What a Python worker has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema, owner: str | None = None) -> DataFrame:
    """``run`` over the Arrow batches of each task; ``owner`` is the module whose caches it uses (default: its own)."""
    ship(df.sparkSession)
    owner = owner or run.__module__

    def alone(batches):
        release(owner)
        return run(batches)

    return df.mapInArrow(alone, schema)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text under fixed names; every other column is left behind."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of equally many rows, of about ``most`` bytes; a row is never cut."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str, piece_bytes: int | None = None) -> DataFrame:
    """``fn(*columns as lists)`` yields output rows for one Arrow batch; they leave in bounded batches.

    With ``piece_bytes``, ``fn`` is called for slices of about that size, and output batches are no larger.
    """
    arrow = _arrow_schema(df.sparkSession, schema)
    most = min(OUT_BYTES, piece_bytes or OUT_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, piece_bytes) if piece_bytes else [batch]:
                rows, size = [], 0
                for row in fn(*(c.to_pylist() for c in part.columns)):
                    rows.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    if size >= most:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, arrow)
                    rows = []
            batch = part = None  # freed before the next one is read

    return map_arrow(df, run, schema, fn.__module__)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)
