"""Incremental arrival of daily files as a Structured Streaming job.

A file-source stream over the landing folder with ``availableNow``: every
run processes the files that arrived since the last run (the checkpoint
remembers what was read, replacing a 'mark as read' step) and upserts each
micro-batch into the Date-partitioned master. A late file for an old Date
simply rewrites that Date's partition, so no watermark is needed. The
micro-batch id is the arrival order for keep-last, and a replayed batch
produces the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftlake.operators import cleaning, master
from shiftlake.params import Params
from shiftlake.sources.files import Landing, stream_lines


def upsert_batch(master_path: str, params: Params, multi_line: bool | None = None):
    """Upsert a micro-batch: its lines are staged once and bound by the headers among them."""
    def _fn(batch: DataFrame, epoch_id: int) -> None:
        landed = Landing(batch, multi_line).bound()
        if landed is not None:
            master.upsert(master_path, cleaning.prepare(landed, params), epoch_id, params)
    return _fn


def start(spark: SparkSession, landing: str, master_path: str, checkpoint: str, params: Params,
          columns: list[str] | None = None, glob: str = "*.csv", max_files_per_trigger: int | None = None,
          multi_line: bool | None = None):
    """``columns`` is not needed any more: every file brings its own header."""
    src = stream_lines(spark, landing, glob, max_files_per_trigger)
    return (src.writeStream.foreachBatch(upsert_batch(master_path, params, multi_line))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_available_now(spark: SparkSession, landing: str, master_path: str, checkpoint: str,
                      params: Params, columns: list[str] | None = None, **kw) -> None:
    """Process everything that has landed, then stop."""
    q = start(spark, landing, master_path, checkpoint, params, columns, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
