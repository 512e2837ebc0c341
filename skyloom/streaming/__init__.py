"""Streams of visibilities: gridding is a sum, so it goes on window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gridding


def weight_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Weights by event-time window and channel, for batches and streams alike."""
    e = F.col("event_id")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), (e % 4).cast("int").alias("chan"), (F.lit(0.25) * (1 + e % 5)).alias("weight"))
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", window), "chan").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    return sums.select(F.unix_seconds("window.start").alias("start"), "chan", "weight", "n")


def grid_windows(vis: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", **grid: object) -> DataFrame:
    """``start, chan, pol, iu, iv, re, im, w``: visibilities gridded by windows of event time, for batches and streams alike.
    The state of a stream is one sum a window and cell: samples are laid out as footprints and summed once, within a
    micro-batch before they reach the state. A window is given out when the watermark (``late`` behind the newest sample that has a weight) has
    passed it, and samples behind the watermark are left out. ``w`` adds up to the window's sum of weights."""
    seen = gridding.spots(vis.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), **grid)
    kernel = {k: v for k, v in grid.items() if k in ("support", "oversampling")}
    wide = gridding.footprints(seen.select(time, "chan", "pol", "ui", "vi", "uo", "vo", "w", "re", "im"), **kernel)
    total = lambda c: F.sum(F.col("k") * F.col(c)).alias(c)
    sums = wide.groupBy(F.window(time, window), "chan", "pol", "iu", "iv").agg(total("re"), total("im"), total("w"))
    return sums.select(F.unix_seconds("window.start").alias("start"), "chan", "pol", "iu", "iv", "re", "im", "w")


def merged(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The grids of many windows as one, ``chan, pol, iu, iv, re, im``, and its ``chan, pol, sum_weight``."""
    cells = windows.groupBy("chan", "pol", "iu", "iv").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return cells, windows.groupBy("chan", "pol").agg(F.sum("w").alias("sum_weight"))
