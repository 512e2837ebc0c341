"""Session defaults shared by tests, benchmarks and examples."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; clusters bring their own and need only DEFAULTS."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skyloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def export_path(spark: SparkSession) -> None:
    """Let Python workers of this machine import this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, in the folder that ``spark.checkpoint.dir`` names. Only local sessions may go without
    that setting: they get a temporary folder; elsewhere executors would not share it, so its absence is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="skyloom-"))
    return df.checkpoint()
