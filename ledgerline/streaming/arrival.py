"""Run the daily reports for every report date whose extracts have landed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerline.params import Params
from ledgerline.plans.daily import run_daily
from ledgerline.session import scratch_dir


def reports_on_arrival(
    spark: SparkSession,
    landing_root: str,
    build_refs: Callable[[str], Mapping[str, DataFrame]],
    params: Params,
    out_root: str,
    trigger_table: str = "invoice",
    checkpoint: str | None = None,
    global_order: bool = True,
) -> StreamingQuery:
    """Start a query that runs :func:`run_daily` once per newly landed report date.

    ``landing_root/<trigger_table>`` is a Parquet folder partitioned by
    ``report_date``; a new partition there means that day's extracts are
    complete. The file source with ``availableNow`` picks up only files not yet
    seen (progress lives in ``checkpoint``, by default under the shared
    ``spark.checkpoint.dir``), and each micro-batch runs the reports for its
    dates. Report writes replace one date partition, so a batch replayed after a
    failure rewrites the same output. Only the distinct dates of a batch reach
    the driver; the reports themselves are distributed jobs.
    """
    src = f"{landing_root.rstrip('/')}/{trigger_table}"
    schema = spark.read.parquet(src).schema
    checkpoint = checkpoint or f"{scratch_dir(spark)}/streams/reports-on-arrival"

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        dates = sorted(str(r[0]) for r in batch.select("report_date").distinct().collect())
        for d in dates:
            run_daily(build_refs(d), params, out_root, d, global_order=global_order)

    return (
        spark.readStream.schema(schema).parquet(src)
        .select("report_date")
        .writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
