"""Sharding by balanced label propagation: linked documents gather in shards of even size.

Documents with equal texts are linked, through a hub per text (its digest), never pair by pair.
Every document starts in a shard drawn from its id. In each round a hub asks for the shard that
most of its documents are in, among those with room for the whole group, and if none of them has,
for one drawn from those that do. Prefix sums over the hubs that ask for a shard grant as many as
it has room for; the others ask again in the next round, until no group moves. Groups of a larger
size class come first, as they fit fewer shards.

A shard's room is its final row count less the groups gathered there. Documents that aren't in a
gathered group take no room: they fill up what is left. Shards above their share hand such
documents on to shards below it, so row counts end at most one apart (law ``rows``) and no gathered
group is split. A group that no shard has room for stays where it is, spread over several shards,
and no task holds it. Ids, digests and shards travel; texts don't.

Null texts count as empty for the link and the checksum and have no bytes. Rows with a null id are
placed like others. Repeated rows are linked. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

BLOCKS = 1024


def numbered(spark: SparkSession, rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows with ``slot``: their place, from 0, in their group by the order given.

    A range sort numbers rows within a partition; the partitions' counts per group, a small table,
    give each partition's start. The sorted rows are written first, so numbers and counts agree.
    """
    ordered = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    fixed = written(spark, ordered.withColumn("__n", F.monotonically_increasing_id()), name)
    part = F.shiftright("__n", 33).alias("__part")
    first = fixed.groupBy(group, part).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__part")) - F.col("__size")
    starts = first.select(group, "__part", (before - F.col("__first")).alias("__shift"))
    return (
        fixed.withColumn("__part", part)
        .join(F.broadcast(starts), [group, "__part"])  # partitions of the sort, and a row more per shard at most
        .withColumn("slot", F.col("__n") + F.col("__shift"))
        .drop("__n", "__part", "__shift")
    )


def propagate(asking: DataFrame, room: list[int], salt: int) -> tuple[DataFrame, DataFrame]:
    """One round over groups (hub, size, held): (hub, size, held, target) of those that fit a shard, and the
    running sum of their sizes in their target, in an order drawn from ``salt``."""
    free = F.array(*[F.lit(n).cast("long") for n in room])
    fits = lambda shard: F.element_at(free, shard + 1) >= F.col("size")
    # ties are broken by a hash, so that no shard is favoured
    most = F.array_max(F.filter("held", lambda x: fits(x["shard"])))["shard"]
    other = F.filter(F.array(*[F.lit(s) for s in range(len(room))]), fits)
    drawn = F.try_element_at(other, (F.pmod(F.xxhash64("hub", F.lit(salt)), F.greatest(F.size(other), F.lit(1))) + 1).cast("int"))
    block = F.pmod(F.xxhash64(F.lit(salt), "hub"), F.lit(BLOCKS))
    wish = asking.withColumn("target", F.coalesce(most, drawn)).where("target is not null").withColumn("block", block)
    return wish, F.element_at(free, F.col("target") + 1)


def granted(wish: DataFrame, room: Column) -> DataFrame:
    """The wishes with ``ok``: whether the sizes up to theirs, over the hubs that ask for the shard, fit its room."""
    # at most shards x BLOCKS rows; a block that begins beyond the room has no grants
    asks = wish.groupBy("target", "block").agg(F.sum("size").alias("asks"))
    before = F.sum("asks").over(Window.partitionBy("target").orderBy("block")) - F.col("asks")
    before = asks.select("target", "block", before.alias("before"))
    own = F.sum("size").over(Window.partitionBy("target", "block").orderBy("hub").rowsBetween(Window.unboundedPreceding, 0))
    return wish.withColumn("own", own).join(F.broadcast(before), ["target", "block"]).withColumn("ok", F.col("before") + F.col("own") <= room)


def gathered(spark: SparkSession, facts: DataFrame, share: list[int]) -> DataFrame:
    """(hub, shard) of the groups of linked documents that found a shard with room for all of them."""
    start = F.pmod(F.xxhash64("key"), F.lit(len(share))).cast("int").alias("shard")
    held = facts.select("hub", start).groupBy("hub", "shard").agg(F.count("*").alias("n"))
    place = F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")
    hubs = held.groupBy("hub").agg(F.sum("n").alias("size"), F.collect_list(place).alias("held"))  # at most one place a shard
    # size classes are powers of four; a group above every share fits nowhere
    rank = F.floor(F.log2("size") / 2).cast("int").alias("class")
    hubs = written(spark, hubs.where((F.col("size") > 1) & (F.col("size") <= max(share))).select("*", rank), "shard-hubs")
    classes = sorted((r["class"] for r in hubs.select("class").distinct().collect()), reverse=True)
    room, placed, salt = list(share), spark.createDataFrame([], hubs.select("hub", F.lit(0).alias("shard")).schema), 0
    for own in classes:
        asking = hubs.where(F.col("class") == own).drop("class")
        while True:
            wish, free = propagate(asking, room, salt)
            told = written(spark, granted(wish, free).select("hub", "size", "held", F.col("target").alias("shard"), "ok"), f"shard-round{salt}")
            salt += 1
            moved = told.where("ok").groupBy("shard").agg(F.sum("size").alias("n")).collect()  # one row per shard
            if not moved:  # the first hub in a target's order is always granted, so none asked
                break
            for r in moved:
                room[r["shard"]] -= r["n"]
            placed = placed.unionByName(told.where("ok").select("hub", "shard"))
            asking = told.where("not ok").select("hub", "size", "held")
    return written(spark, placed, "shard-placed")


def label_propagation_shards(
    spark: SparkSession, docs: DataFrame, shards: int = 40,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Rounds of propagation until no group moves, under quotas of the final counts; then the other
    documents even the counts exactly.
    """
    text = text_or_empty(text_col)
    facts = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("hub"),
    )
    facts = written(spark, facts.withColumn("key", F.monotonically_increasing_id()), "shard-facts")
    total = facts.count()
    share = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    placed = gathered(spark, facts, share).withColumnRenamed("shard", "own")
    everyone = facts.select("key", "hub").join(placed, "hub", "left")
    everyone = everyone.select("key", "hub", F.coalesce("own", start).alias("shard"), F.col("own").isNotNull().alias("whole"))
    # gathered groups first: they fit the share, so what a shard hands on from its end is never one of them
    order = [F.col("whole").desc(), F.col("hub"), F.col("key")]
    placed = written(spark, numbered(spark, everyone, "shard", order, "shard-order"), "shard-slots")
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    quota = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("shard") + 1)
    stays = placed.where(F.col("slot") < quota).select("key", "shard", "slot")
    # gaps in shard order take the handed-on documents in their order
    free = [max(0, share[s] - counts.get(s, 0)) for s in range(shards)]
    surplus = [max(0, counts.get(s, 0) - share[s]) for s in range(shards)]
    handed = placed.where(F.col("slot") >= quota)
    index = F.element_at(F.array(*[F.lit(sum(surplus[:s]) - share[s]).cast("long") for s in range(shards)]), F.col("shard") + 1)
    handed = handed.withColumn("n", F.col("slot") + index)
    ends = [sum(free[: s + 1]) for s in range(shards)]
    target = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= F.col("n")))
    base = F.element_at(F.array(*[F.lit(counts.get(s, 0) - (ends[s] - free[s])).cast("long") for s in range(shards)]), F.col("to") + 1)
    moved = handed.withColumn("to", target).select("key", F.col("to").alias("shard"), (F.col("n") + base).alias("slot"))
    return (
        facts.join(stays.unionByName(moved), "key")
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
