"""Structured Streaming entry: run the daily reports as extracts land.

The source reports have no stream processing (no event time, watermark or
state). What arrives incrementally is the daily extract drop itself; this
package runs the batch daily job for each newly landed report date.
"""

from ledgerline.streaming.arrival import reports_on_arrival

__all__ = ["reports_on_arrival"]
