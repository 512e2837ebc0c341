"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as in the contracts.
SPACE = r"\x20\x09-\x0D"
#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 16 << 20
#: Folders that ``materialize`` makes.
TAGGED = re.compile(r"[a-z-]+-[0-9a-f]{32}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Only local sessions may go without
    that setting: they get a temporary folder; elsewhere its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skyloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more: all that was derived from them is a table of
    its own by now, so a lost executor asks for them no more."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if TAGGED.fullmatch(folder.rsplit("/", 1)[-1]) and all(f.startswith(folder) for f in files):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where the fold of a document is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True where models may learn from a document: not held out and with an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to Arrow batches of bounded bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def sample_fraction(counts: int, wanted: int) -> int:
    """Of 2**20 hash values, how many keep about ``wanted`` of ``counts`` rows."""
    return (1 << 20) if counts <= wanted else max(1, round((1 << 20) * wanted / counts))


def hash_slot(key: Column, seed: int = 7) -> Column:
    """A reproducible value in 0 .. 2**20-1 for bounded training samples."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 20))
