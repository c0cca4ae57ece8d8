"""Exact deduplication as a stateful stream.

Every text's digest, identifier and locator (file and row) are written as a small table and
streamed from it. The streaming state, keyed by digest and held on disk by RocksDB, keeps the
identifier that stays, where its content is, and how many rows came; there is no watermark, so
state never expires and a later run with the same state folder goes on where the last one ended.
Digests seen more than once are hits: their rows' full bytes are fetched again and compared, by
grouping on (digest, text). A digest's rows are read in shares, by the row's locator, so those of a
digest with a third of all rows are spread over tasks, and each task adds up its copies. Should texts differ under one digest, they are told apart by content.

Equal means identical text; null counts as empty. The row with the largest identifier stays;
null identifiers stay only where a group has no other. Rows repeated with the same identifier and
text are all marked as kept in the report, and ``deduplicated`` leaves one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, text_or_empty, unused, written

#: Shares of a digest's rows in the byte comparison.
SALTS = 32
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold inside the block; "__" stands for a dot."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def locators(docs: DataFrame) -> Column:
    """File and row of each document; null where the rows come from no file."""
    try:
        meta = docs.metadataColumn("_metadata")
        place = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))
        docs.select(place)
        return place
    except AnalysisException:
        return F.lit(None).cast("struct<file: string, row: bigint>")


def remembered(spark: SparkSession, signatures: str, schema: T.StructType, state: str, **options: str) -> DataFrame:
    """Stream a folder of (id, digest, place) rows through the keyed state; one row per digest so far."""
    table = f"{state}/changed"
    rows = spark.readStream.schema(schema).options(**options).parquet(signatures)
    seen = rows.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.max_by("place", "id").alias("place"), F.count("*").alias("group_size")
    )

    def put(changed: DataFrame, batch: int) -> None:  # a batch that is run again replaces its own rows
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
                  spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
                  spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
                  spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="64",
                  spark__sql__streaming__stateStore__maintenanceInterval="10s"):
        query = (
            seen.writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True)
            .option("checkpointLocation", f"{state}/stream").start()
        )
        query.awaitTermination()
    kept = T.StructType([*seen.schema.fields, T.StructField("batch", T.LongType())])
    return (
        spark.read.schema(kept).parquet(table)
        .groupBy("digest")
        .agg(F.max_by(F.struct("keep_id", "place", "group_size"), "batch").alias("x"))
        .select("digest", "x.*")
    )


def checked_groups(spark: SparkSession, docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows of hits, compared by their full bytes: (digest, text, keep_id, group_size) per different text.

    A digest's rows meet its hit in ``SALTS`` shares, so those of a hot one go to as many tasks; each
    task adds up equal texts before they are dealt by (digest, text)."""
    rows = docs.select("id", digest(F.col("text")).alias("digest"), "text", F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).alias("salt"))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    hits = state.where(F.col("group_size") > 1).select("digest", "group_size", shares)
    # a filter over a scan again, from which Spark makes the Bloom filter
    hits = written(spark, hits, "dedup-shares").where(F.col("group_size") > 1)
    return rows.join(hits, ["digest", "salt"], "left_semi").groupBy("digest", "text").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    )


def duplicate_report(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    **stream_options: str,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    folder = scratch(spark, "dedup")
    plain = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), locators(docs).alias("place"))
    signed = docs.select(
        F.col(id_col).alias("id"), digest(text_or_empty(text_col)).alias("digest"), locators(docs).alias("place"),
        sha256(text_or_empty(text_col)).alias("text_sha256"),
    )
    if digest is sha256:
        signed = signed.drop("text_sha256")
    signed.write.parquet(f"{folder}/signatures")
    state = written(spark, remembered(spark, f"{folder}/signatures", signed.schema, f"{folder}/state", **stream_options), "dedup-state")
    # a Bloom filter of the hits, of bounded size, keeps other texts out of the shuffle
    with settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        groups = checked_groups(spark, plain, state, digest)
        compared = written(
            spark, groups.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("group_size").alias("rows")), "dedup-hits"
        )
    mixed = compared.where(F.col("texts") > 1).select("digest")
    rows = spark.read.schema(signed.schema).parquet(f"{folder}/signatures")
    sha = F.col("digest") if digest is sha256 else F.col("text_sha256")
    columns = ["id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256")]
    if mixed.isEmpty():
        out = rows.join(state.drop("place"), "digest").select(*columns)
    else:
        clean = rows.join(state.drop("place"), "digest").join(mixed, "digest", "left_anti").select(*columns)
        groups = checked_groups(spark, plain, state, digest).join(mixed, "digest", "left_semi")
        told = (
            plain.withColumn("digest", digest(F.col("text"))).withColumn("text_sha256", sha256(F.col("text")))
            .join(groups, ["digest", "text"]).select(*columns[:-1], F.col("text_sha256"))
        )
        out = clean.unionByName(told)
    return out.withColumnRenamed("id", id_col)


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **stream_options: str) -> DataFrame:
    """The documents that stay, with all their columns."""
    report = written(spark, duplicate_report(spark, docs, id_col, text_col, **stream_options), "dedup-report")
    own, other = unused(docs, "own_key"), unused(docs, "other_key")
    key = F.struct(F.col(id_col).alias("id"), F.col("text_sha256")).alias(other)
    gone = report.where(~F.col("kept")).select(key)
    twice = report.where(F.col("kept")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(other)
    keyed = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), sha256(text_or_empty(text_col)).alias("text_sha256")))
    match = F.col(own).eqNullSafe(F.col(other))
    left = keyed.join(gone, match, "left_anti")
    if twice.isEmpty():
        return left.drop(own)
    one = left.join(twice, match, "left_semi").dropDuplicates([own])
    return left.join(twice, match, "left_anti").unionByName(one).drop(own)
