"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's key is hashed into one of ``SLOTS`` virtual slots. The slots' bytes are added up, and a map says which shard holds
each slot. Maps have versions: version 1 deals slots out by number alone; ``rebalanced`` edits a version into the next one by
moving no more slots than it takes to make the bytes of shards near equal, and ``grown`` moves slots into a new shard only.
Records follow their slot, so an edit of the map moves whole slots and hashes nothing anew.

A slot that holds more than a ``PARTS``-th of a shard (one key may have a third of all rows) is split into parts, among
which its rows are dealt in turn; the map then places the parts. There are at most ``SLOTS + PARTS * shards`` units to
place, whatever the input, so the map is broadcast and planned in one place. Texts are read once, into a table of sizes
and checksums; positions within a shard are numbered by runs of at most ``RUN`` rows or so, never by shard.

Defined results: a null text has no bytes (size 8, checksum 0), a null id is a key as any other; repeated rows are rows of
their own. Numbering within a shard follows slots, so a moved slot is a contiguous range. A record larger than a shard's
share can't be split: then bytes are as equal as whole records allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read

SLOTS = 4096
#: Units that a shard's fair share of bytes is cut into where one slot holds that much.
PARTS = 64
#: Rows that are numbered together.
RUN = 100_000


def virtual_slot(*keys: Column) -> Column:
    """The slot of a key: the same for all time."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def digest(documents: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, turn``: all of a record but its text; ``turn`` deals the rows of one slot."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot("doc_id").alias("virtual_slot"),
        F.xxhash64(F.monotonically_increasing_id()).alias("turn"),
    )


def unit_sizes(records: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The parts of each slot that is split, and ``virtual_slot, part, rows, bytes`` of all units."""
    slots = records.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / (shards * PARTS)  # a row a slot
    parts = slots.withColumn("parts", F.greatest(F.lit(1), F.floor(F.col("bytes") / share)).cast("int"))
    parts = materialize(parts.select("virtual_slot", "parts"), "shard-parts")
    units = in_parts(records, parts).groupBy("virtual_slot", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return parts, materialize(units, "shard-units")


def in_parts(records: DataFrame, parts: DataFrame) -> DataFrame:
    """``records`` with the part of their slot."""
    return records.join(F.broadcast(parts), "virtual_slot", "left").withColumn("part", F.pmod("turn", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def first_map(units: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map, by the numbers of slots alone: ``version, virtual_slot, part, shard``."""
    return units.select(F.lit(1).alias("version"), "virtual_slot", "part", F.pmod(F.col("virtual_slot") + F.col("part"), F.lit(shards)).cast("int").alias("shard"))


def _placed(marked: DataFrame, targets: list[int]) -> DataFrame:
    """The units that don't stay, largest first, each on the one of ``targets`` that holds least. One row a unit, so at most
    ``SLOTS + PARTS * shards``; the loads are an array that one aggregation carries along."""
    unit = F.struct((-F.col("bytes")).alias("b"), F.col("virtual_slot").alias("s"), F.col("part").alias("p"))
    queue = F.array_sort(F.collect_list(F.when(~F.col("stays"), unit)))
    held = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("long") for s in targets]
    loads = F.array(*[F.struct(h.alias("load"), F.lit(s).alias("shard")) for h, s in zip(held, targets)])
    one = marked.agg(queue.alias("queue"), loads.alias("loads"))
    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("shards"))

    def place(state: Column, u: Column) -> Column:
        least = F.array_min(state["loads"])
        added = F.transform(state["loads"], lambda x: F.struct((x["load"] + F.when(x["shard"] == least["shard"], -u["b"]).otherwise(F.lit(0))).alias("load"), x["shard"].alias("shard")))
        return F.struct(added.alias("loads"), F.concat(state["shards"], F.array(least["shard"])).alias("shards"))

    done = one.select("queue", F.aggregate("queue", start, place)["shards"].alias("shards"))
    return done.select(F.explode(F.arrays_zip("queue", "shards")).alias("x")).select(F.col("x.queue.s").alias("virtual_slot"), F.col("x.queue.p").alias("part"), F.col("x.shards").alias("shard"), (-F.col("x.queue.b")).alias("bytes"))


def _next(units: DataFrame, current: DataFrame, targets: list[int], shards: int) -> DataFrame:
    """The map after ``current``: shards keep their largest units up to an even share, the others go to ``targets``."""
    now = current.join(units.select("virtual_slot", "part", "bytes"), ["virtual_slot", "part"])
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards  # a row a unit
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot", "part")
    marked = now.withColumn("share", share).withColumn("run", F.sum("bytes").over(largest))
    marked = materialize(marked.withColumn("stays", F.col("run") <= F.col("share")), "shard-marked")
    version = (current.agg(F.max("version")).first()[0] or 0) + 1
    after = marked.where("stays").select("virtual_slot", "part", "shard").unionByName(_placed(marked, targets).select("virtual_slot", "part", "shard"))
    return materialize(after.select(F.lit(version).alias("version"), "virtual_slot", "part", "shard"), "shard-map")


def rebalanced(units: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with bytes near equal over ``shards``; only what exceeds an even share moves."""
    return _next(units, current, list(range(shards)), shards)


def grown(units: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for one shard more than its ``shards``: units move to the new shard only."""
    return _next(units, current, [shards], shards + 1)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The units that an edit of the map moves: ``virtual_slot, part, source, target``."""
    old = before.select("virtual_slot", "part", F.col("shard").alias("source"))
    new = after.select("virtual_slot", "part", F.col("shard").alias("target"))
    return old.join(new, ["virtual_slot", "part"]).where("source <> target")


def placed(records: DataFrame, parts: DataFrame, units: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Each record with its ``shard`` and ``slot``, its position in the shard."""
    runs = F.ceil(F.col("rows") / RUN).cast("int")
    whole = materialize(shard_map.join(units, ["virtual_slot", "part"]).select("virtual_slot", "part", "shard", runs.alias("runs")), "shard-where")
    rows = in_parts(records, parts).join(F.broadcast(whole), ["virtual_slot", "part"])
    rows = rows.withColumn("run", F.pmod(F.shiftright("turn", 20), "runs").cast("int")).drop("runs")
    # Runs are added up in two steps: within a unit, and over the units of a shard.
    sizes = materialize(rows.groupBy("shard", "virtual_slot", "part", "run").agg(F.count("*").alias("held")), "shard-runs")
    inside = Window.partitionBy("virtual_slot", "part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    unit = sizes.groupBy("shard", "virtual_slot", "part").agg(F.sum("held").alias("held"))
    unit = unit.select("virtual_slot", "part", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("before"))
    start = sizes.withColumn("ahead", F.coalesce(F.sum("held").over(inside), F.lit(0))).join(F.broadcast(unit), ["virtual_slot", "part"])
    start = start.select("virtual_slot", "part", "run", (F.col("ahead") + F.col("before")).alias("start"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part", "run").orderBy("doc_id", "turn")) - 1
    return rows.withColumn("place", place).join(start, ["virtual_slot", "part", "run"]).withColumn("slot", F.col("start") + F.col("place")).drop("start", "place")


def shard(documents: DataFrame, shards: int = 24) -> tuple[DataFrame, DataFrame]:
    """``doc_id, size, text_crc32, shard, slot, virtual_slot, part`` of every row, and the map with its versions."""
    records = materialize(digest(documents), "shard-records")
    parts, units = unit_sizes(records, shards)
    first = materialize(first_map(units, shards), "shard-map")
    second = rebalanced(units, first, shards)
    where = placed(records, parts, units, second)
    return where.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", "part"), first.unionByName(second)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = shard(read(spark, sf_dir, "documents"))
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
