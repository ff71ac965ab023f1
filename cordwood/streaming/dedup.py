"""Keep redelivered rows of a stream out of a stored table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cordwood.operators import ingest
from cordwood.schema import LOG_COLUMNS
from cordwood.sources.id_filter import IdFilter
from cordwood.sources.log_table import LogTable


def append_new(logs: DataFrame, table: LogTable, batch: str, ids: IdFilter | None = None) -> int:
    """Append the rows whose id the table does not hold yet; how many ids had to be looked up.

    Copies of an id have the same time, so only the days that the batch touches are searched, and
    there the filter of ids first: stored rows are read only for ids whose bits are all set, and
    only from the days and the span of time in which such ids lie. Rows of the same batch do not
    count as held: a batch that is written again replaces itself.
    """
    ids = ids or IdFilter(table.spark, table)
    once = ids.placed(ingest.drop_redelivered(logs.select(*LOG_COLUMNS))).persist()
    try:
        touched = once.select(F.to_date("timestamp").cast("string").alias("day")).distinct()
        days = sorted({row["day"] for row in touched.collect()} & set(table.days()))
        fresh, asked = once, 0
        if days:
            ids.cover(days, batch)
            suspects = ids.suspects(once, days, batch).select("id", "timestamp").persist()
            span = suspects.agg(
                F.count(F.lit(1)).alias("ids"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
                F.collect_set(F.to_date("timestamp").cast("string")).alias("days"),
            ).first()
            asked = span["ids"]
            if asked:
                held = table.scan_days([day for day in days if day in span["days"]]).where(
                    (F.col("batch") != batch) & F.col("timestamp").between(F.lit(span["first"]), F.lit(span["last"]))
                )
                known = suspects.join(held.select("id"), "id", "left_semi").select("id")
                fresh = once.join(known, "id", "left_anti")
        ids.add(once, batch)
        table.append(fresh, batch)
        return asked
    finally:
        once.unpersist()


def start_dedup(
    logs: DataFrame,
    table: LogTable,
    checkpoint: str,
    name: str = "dedup",
    processing_time: str | None = None,
    merge_every: int | None = None,
) -> StreamingQuery:
    """Run a stream of logs into a table that gets each id once.

    Copies may come any time apart and in any order: there is no watermark, and no state but the
    table itself and its filter of ids. ``name`` must stay the same when the stream is restarted;
    one stream at a time may write to the table. After every ``merge_every`` micro-batches the small
    files of past days are merged; the last micro-batch, which may come again, is spared.
    """
    ids = IdFilter(table.spark, table)

    def save(rows: DataFrame, number: int) -> None:
        batch = f"{name}-{number}"
        append_new(rows, table, batch, ids)
        if merge_every and number % merge_every == merge_every - 1:
            today = datetime.now(timezone.utc).date()
            for stored in (table, ids.rows):
                stored.merge(today, {batch})

    writer = logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    if processing_time is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()
