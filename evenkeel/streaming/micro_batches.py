"""Skew joins of a stream with a table: each micro-batch is a bounded probe side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.joins import skew_join


def skew_join_stream(stream: DataFrame, table: DataFrame, on: str | list[str], sink: Callable[[DataFrame, int], None], strategy: str = "auto", **options) -> DataStreamWriter:
    """A writer, to be started, that gives sink the join of each micro-batch with table, and the batch's number.

    Hot keys are found anew in every batch, so that keys which become hot are spread from then on.
    Sinks that overwrite by batch number make it exactly once.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            sink(skew_join(kept, table, on, strategy, **options), number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each)
