"""Windowed sums of a stream, kept in a stored table: bounded state, late rows, each batch once.

Sums run in update mode below a watermark: a window's state goes once the watermark has passed its end, and until then
every batch that changes a window replaces its stored row. What comes too late for a window is set aside as it is. The
rows of a batch and the windows that it changes are one streaming query, so the source is followed once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import MonthTable


class Lateness:
    """The watermark below which Spark drops a batch's rows, from the times seen in the batches before it.

    A batch drops what is below the watermark by which the batch before it cleared its state. Times are microseconds; the
    watermark is whole milliseconds.
    """

    def __init__(self, marks: dict, delay: timedelta):
        self._seen, self._cleared, self._delay = marks.get("seen"), marks.get("cleared"), delay // timedelta(microseconds=1)
        self.limit: int | None = self._cleared

    def after(self, newest: int | None) -> dict:
        """Marks for the next batch, given this one's newest time."""
        cleared = None if self._seen is None else self._seen // 1000 * 1000 - self._delay
        seen = max((t for t in (self._seen, newest) if t is not None), default=None)
        return {"seen": seen, "cleared": cleared}


def keep_windows(rows: DataFrame, sums: Callable[[DataFrame], DataFrame], time: str, closes: Column, delay: timedelta, table: MonthTable, late: str, checkpoint: str) -> StreamingQuery:
    """Start a query that merges ``sums`` of the stream ``rows`` into table until all that is available now has been read.

    sums: from rows with a watermark to a windowed aggregation whose columns are the table's. closes: when the first of a
    row's windows ends. Rows that come ``delay`` or more after that, behind the newest time of the batches before, are
    written to late/batch=<n>; the table's mark ``late`` is their number. The table is created by the first batch. A
    batch that is run again, after a failure, finds its number in the table's marks and changes nothing.
    """
    marked = rows.withWatermark(time, f"{int(delay.total_seconds() * 1000)} milliseconds")
    windows = sums(marked)
    columns, own = windows.columns, rows.columns
    both = windows.select(F.struct(*columns).alias("window"), F.lit(None).cast(rows.schema).alias("row")).union(
        marked.select(F.lit(None).cast(windows.schema).alias("window"), F.struct(*own).alias("row"))
    )

    def keep(batch: DataFrame, number: int) -> None:
        marks = table.state()["marks"]
        if marks.get("batch", -1) >= number:
            batch.write.format("noop").mode("overwrite").save()  # Spark's state of this batch still has to be made
            return
        batch.persist()
        try:
            given = batch.where("row is not null").select("row.*")
            lateness = Lateness(marks, delay)
            below = F.lit(False) if lateness.limit is None else F.unix_micros(closes) <= lateness.limit
            newest, n_late = given.agg(F.max(F.unix_micros(time)), F.count_if(F.coalesce(below, F.lit(False)))).first()
            if n_late:
                given.where(below).write.mode("overwrite").parquet(f"{late}/batch={number}")
            changed = batch.where("window is not null").select("window.*")
            marks = {"batch": number, "late": marks.get("late", 0) + n_late, **lateness.after(newest)}
            if table.version() is None:
                table.create(changed, marks)
            else:
                table.merge(changed, marks=marks)
                table.expire(keep=3)
        finally:
            batch.unpersist()

    return both.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

