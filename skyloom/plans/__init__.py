"""Relations of visibilities and images over the driver's tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visibility a row."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (e * 37 % 2001 - 1000).cast("double").alias("u"),
        (e * 91 % 1801 - 900).cast("double").alias("v"),
        (e * 53 % 401 - 200).cast("double").alias("w"),
        (e % 4).cast("int").alias("chan"),
        (F.lit(1.4e9) + (e % 4) * F.lit(1e7)).alias("freq"),
        (e % 2).cast("int").alias("pol"),
        F.col("value").alias("re"),
        (F.col("value") * 0.5).alias("im"),
        (F.lit(0.25) * (1 + e % 5)).alias("weight"),
        (e % 17 == 0).alias("flag"),
        (F.col("user_id") % 10).cast("int").alias("ant1"),
        F.expr("cast((user_id div 10) % 10 as int)").alias("ant2"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
    )


VIS = """vis AS (SELECT event_id, ((event_id*37)%2001-1000)::DOUBLE AS u, ((event_id*91)%1801-900)::DOUBLE AS v,
 ((event_id*53)%401-200)::DOUBLE AS w, (event_id%4)::INT AS chan, 1.4e9+(event_id%4)*1e7 AS freq, (event_id%2)::INT AS pol, value AS re,
 value*0.5e0 AS im, 0.25e0*(1+event_id%5) AS weight, event_id%17=0 AS flag, (user_id%10)::INT AS ant1, ((user_id//10)%10)::INT AS ant2,
 epoch(ts) AS t FROM events)"""


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel a row: each embedding is a plane of 8 x 8 pixels."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plane"), F.col("label").alias("chan"), F.posexplode("embedding").alias("i", "x"))
    return flat.select("plane", "chan", F.expr("i div 8").cast("int").alias("l"), (F.col("i") % 8).alias("m"), F.col("x").cast("double").alias("value"))


IMG = """img AS (SELECT vec_id AS plane, label AS chan, ((i-1)//8)::INT AS l, ((i-1)%8)::INT AS m, x::DOUBLE AS value
 FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def ret_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of deconvolution cycles: planes are users, cycles follow the events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("int").alias("chan"), (e % 2).cast("int").alias("pol"), e.alias("cycle"), F.col("value").alias("peakres"),
        (e % 3).alias("masksum"), (e % 100).alias("iter_done"), (F.col("value") * 0.25).alias("model_flux"), (F.lit(0.01) * (e % 30)).alias("max_psf_sidelobe"),
    )


RET_LOG = """ret_log AS (SELECT (user_id%5)::INT AS chan, (event_id%2)::INT AS pol, event_id AS cycle, value AS peakres, event_id%3 AS masksum,
 event_id%100 AS iter_done, value*0.25e0 AS model_flux, 0.01e0*(event_id%30) AS max_psf_sidelobe FROM events)"""


def tidy(x, digits: int = 6):
    """Rounded so that sums in any order compare; never -0."""
    return F.round(x, digits) + F.lit(0.0)
