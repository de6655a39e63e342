"""Period statistics of a stream: the streaming form of operators.stats.period_stats, for sums and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods
from ..operators.stats import Metric

WINDOWS = {"day": "1 day", "week": "1 week"}


def stream_stats(events: DataFrame, time_column: str, granularity: str, metrics: list[Metric], *, late: str = "1 day") -> DataFrame:
    """A row a closed day or week: period_start, period_end, period_key, row_count and a column a metric.

    Rows later than the watermark are left out, and a period is emitted once it is past it.  Weeks begin on Mondays.
    Distinct counts are not available on streams.
    """
    if granularity not in WINDOWS:
        raise ValueError("streams have periods of a day or a week")
    if any(m.method == "distinct_count" for m in metrics):
        raise ValueError("distinct_count is not available on streams")
    rows = events.withColumn("__ts", F.expr(time_column).cast("timestamp")).withWatermark("__ts", late)
    span = F.window("__ts", WINDOWS[granularity], startTime="4 days" if granularity == "week" else "0 seconds")
    out = rows.groupBy(span.alias("__w")).agg(F.count(F.lit(1)).alias("row_count"), *[m.aggregate().alias(m.label) for m in metrics])
    start = F.col("__w.start").cast("timestamp_ntz")
    return out.select(start.alias("period_start"), F.col("__w.end").cast("timestamp_ntz").alias("period_end"), periods.key_of(granularity, start).alias("period_key"), "row_count", *[F.col(f"`{m.label}`") for m in metrics])
