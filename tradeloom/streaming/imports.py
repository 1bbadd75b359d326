"""Tracker lines as they arrive, appended to the stored trades: each import key once, whenever its lines come.

Two things keep a key from coming in twice. A line that is delivered again soon (a repeated upload) ends in Spark's keyed
state, which forgets it after a horizon. Whatever gets past that meets the keys of the stored trades, of the batch's own
months only; there is no horizon, since the table is what was accepted.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import IMPORT_KEY, may_be_trade, parse_tracker
from ..sources.versions import NO_MONTH, MonthTable


def stored_trades(spark, path: str) -> MonthTable:
    """Trades by the month of their entry, the day that an import key holds."""
    return MonthTable(spark, path, ["trade_id"], F.col("date"))


def new_rows(lines: DataFrame, table: MonthTable, as_of: Column) -> tuple[DataFrame, list[str]]:
    """(rows of lines whose key isn't stored, each key's first line; their months). Only these months' keys are read."""
    return _new(parse_tracker(lines, as_of), table)


def _new(rows: DataFrame, table: MonthTable) -> tuple[DataFrame, list[str]]:
    """new_rows() of parsed lines."""
    others = [c for c in rows.columns if c not in (*IMPORT_KEY, "line_no")]
    first = rows.groupBy(*IMPORT_KEY).agg(F.min_by(F.struct(*others), "line_no").alias("r")).select(*IMPORT_KEY, "r.*")
    months = sorted(r.m for r in rows.select(F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(NO_MONTH)).alias("m")).distinct().collect())
    known = table.read(months=months).select("user_id", F.upper("ticker").alias("ticker"), "date", "buy_price")
    return first.join(known, IMPORT_KEY, "left_anti"), months


def import_lines(lines: DataFrame, table: MonthTable, as_of: Column, now: Column, horizon: timedelta, checkpoint: str, name: str = "import") -> StreamingQuery:
    """Start a query that appends the trades of ``lines`` (user_id, line_no, line, arrived) until all available is read.

    Within a batch the first line of a key (by line_no) counts, across batches the first batch. The table has to be there.
    Its marks tell, under ``name``, the last batch and how many rows have been imported and how many were given that are
    rows at all (the rest of these were skipped); lines that Spark's state drops are in the query's progress. A batch that
    is run again changes nothing.
    """
    marked = lines.withWatermark("arrived", f"{int(horizon.total_seconds())} seconds")
    # titles and the like aren't kept in the state; a condition on the event time as well, since any other would be moved
    # below the watermark, which their arrival moves on
    marked = marked.where(F.when(F.col("arrived").isNull(), F.col("line").contains(",")).otherwise(may_be_trade()))
    fresh = marked.dropDuplicatesWithinWatermark(["user_id", "line"])

    def append(batch: DataFrame, number: int) -> None:
        marks = table.state()["marks"].get(name, {"batch": -1, "imported": 0, "rows": 0})
        if marks["batch"] >= number:
            batch.write.format("noop").mode("overwrite").save()  # Spark's state of this batch still has to be made
            return
        parsed = parse_tracker(batch, as_of).persist()  # lines are taken apart once
        try:
            given = parsed.count()
            if not given:
                return
            rows, _ = _new(parsed, table)
            own = F.concat(F.lit("import-"), F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in IMPORT_KEY))))
            rows = rows.select(own.alias("trade_id"), "*").withColumns({"created_at": now, "updated_at": now}).persist()
            table.merge(rows, marks={name: {"batch": number, "imported": marks["imported"] + rows.count(), "rows": marks["rows"] + given}}, within=[])
            table.expire(keep=3)
            rows.unpersist()
        finally:
            parsed.unpersist()

    return fresh.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
