"""Scans and sinks of visibilities and images: Parquet, partitioned by channel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def open_processing_set(spark: SparkSession, path: str, intents: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A lazy scan; the intent filter prunes partitions, ``columns`` reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("scan_intent").isin(intents)) if intents else df
    return df.select(*columns) if columns else df


def processing_set_summary(vis: DataFrame) -> DataFrame:
    """One row a channel and polarisation: samples, flagged ones, and the frequency."""
    return vis.groupBy("chan", "pol").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("flagged"), F.min("freq").alias("freq"))


def open_image(spark: SparkSession, path: str, block: Column | None = None) -> DataFrame:
    """An image's pixels, or a block of them; an older name of the beam column is replaced."""
    df = spark.read.parquet(path)
    df = df.withColumnRenamed("BEAM", "BEAM_FIT_PARAMS_SKY")
    return df if block is None else df.where(block)


def write_image(img: DataFrame, path: str, overwrite: bool = False, chunks: bool = False) -> None:
    """Raises where the image exists, unless told to overwrite it; ``chunks`` replaces only the channels at hand."""
    writer = img.write.partitionBy("chan")
    if chunks:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def empty_image(spark: SparkSession, n: int, channels: int = 1, pols: int = 1) -> DataFrame:
    """Zero pixels with their coordinates' indices."""
    at = F.col("id")
    cells = n * n * pols
    return spark.range(n * n * channels * pols).select(
        (at / cells).cast("int").alias("chan"), ((at / (n * n)).cast("int") % pols).alias("pol"), ((at / n).cast("int") % n).alias("l"), (at % n).cast("int").alias("m"), F.lit(0.0).alias("value")
    )


def read_regions(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def chunk_size(channels: int, pixels: int, pols: int, memory_gb: float, threads: int, bytes_per_pixel: int = 72) -> int:
    """Channels of a chunk that fit a thread's memory, so many that there are four chunks a thread where channels allow."""
    each = max(1, int(memory_gb * 2**30 / threads / (1.2 * pixels * pols * bytes_per_pixel)))
    return max(1, min(each, channels // (4 * threads)))


def in_chunks(vis: DataFrame, size: int) -> DataFrame:
    """``vis`` with ``chunk``, dealt out by it: what images ``size`` channels at a time stays in one partition."""
    return vis.withColumn("chunk", F.expr(f"cast(chan div {int(size)} as int)")).repartition("chunk")


def chunk_summary(vis: DataFrame, size: int) -> DataFrame:
    """``chunk, first, channels, n, flagged``: the channels and samples of each chunk."""
    chunk = F.expr(f"cast(chan div {int(size)} as int)").alias("chunk")
    flagged = F.sum(F.col("flag").cast("long")).alias("flagged")
    return vis.groupBy(chunk).agg(F.min("chan").alias("first"), F.count_distinct("chan").alias("channels"), F.count("*").alias("n"), flagged)


def chunk_counts(sizes: dict[str, int], memory_gb: float, threads: int, bytes_per_place: float) -> dict[str, int]:
    """Into how many chunks each axis is cut: as many in all as memory asks for (a chunk and its work fit a thread's share),
    or four a thread, as far as the axes go. The longest chunks are halved, cut in three and so on, axis by axis."""
    if not sizes or min(sizes.values()) < 1 or threads < 1:
        raise ValueError("axes have a place at least, and there is a thread at least")
    places = math.prod(sizes.values())
    held = memory_gb * 2**30 / threads / (1.2 * bytes_per_place)
    if held < 1:
        raise ValueError("a thread's memory does not hold a single place")
    wanted = min(places, max(math.ceil(places / held), 4 * threads))
    counts = dict.fromkeys(sizes, 1)
    # The largest chunk counts, so memory holds where an axis does not divide evenly.
    largest = lambda: math.prod(-(-size // counts[axis]) for axis, size in sizes.items())
    while math.prod(counts.values()) < wanted or largest() > held:
        counts[max((a for a in sizes if counts[a] < sizes[a]), key=lambda a: sizes[a] / counts[a])] += 1
    return counts


def with_chunks(rows: DataFrame, sizes: dict[str, int], counts: dict[str, int]) -> DataFrame:
    """``rows`` with ``chunk_<axis>`` for each axis: chunks of an axis differ by a place at most."""
    return rows.withColumns({f"chunk_{axis}": F.expr(f"cast({axis} * {counts[axis]}L div {size} as int)") for axis, size in sizes.items()})


def write_chunks(img: DataFrame, path: str, sizes: dict[str, int], counts: dict[str, int], overwrite: bool = False) -> None:
    """An image cut along several axes, a folder a chunk: one shuffle by chunk, and a file of each. ``open_image`` with a
    ``block`` of chunk numbers reads only these."""
    names = [f"chunk_{axis}" for axis in sizes]
    frame = with_chunks(img, sizes, counts).repartition(*names)
    frame.write.partitionBy(*names).mode("overwrite" if overwrite else "errorifexists").parquet(path)
