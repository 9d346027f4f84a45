"""Summaries of streams: additive state, so a stream's summary equals the batch's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import SummaryMatrix
from ..operators.summary import dense_summary


def kept(rows: DataFrame, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """An aggregated stream, kept complete in the table `name`; `once` ends it when all that is there is read."""
    out = rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def running_summary(stream: DataFrame, cols: Sequence[str], name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """n, sums and sums of squares of a stream, kept complete in the table `name`."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in cols), *(F.sum(F.col(c) * F.col(c)).alias(f"square_{c}") for c in cols)]
    return kept(stream.agg(*sums), name, checkpoint, once)


def windowed_summary(stream: DataFrame, ts: str, cols: Sequence[str], length: str, late: str) -> DataFrame:
    """Diagonal summaries of event-time windows; rows later than `late` are dropped."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in cols), *(F.sum(F.col(c) * F.col(c)).alias(f"square_{c}") for c in cols)]
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length)).agg(*sums)


class Accumulator:
    """A foreachBatch target: adds each micro-batch's full summary once, by batch id, and reports the model so far."""

    def __init__(self, cols: Sequence[str], report: Callable[[int, SummaryMatrix], None] = lambda batch, total: None):
        self.cols, self.report, self.parts = list(cols), report, {}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.parts[batch_id] = SummaryMatrix.of(dense_summary(batch, self.cols))  # a replayed batch replaces itself
        self.report(batch_id, self.total())

    def total(self) -> SummaryMatrix | None:
        out = None
        for p in self.parts.values():
            out = p if out is None else out + p
        return out
