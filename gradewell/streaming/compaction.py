"""S2 over many small files: a compaction stage that packs one-document files into large ones.

A file stream lists new files, in batches of bounded count, and its checkpoint remembers which were
packed, so a run that is stopped goes on where it ended and later runs pack later files only. Every
document keeps its file's name and path. A batch is written as a folder of its own, replaced when
the batch is replayed: no document is packed twice.

Files are known by their path: one that is written again under its path isn't read again. An empty
folder gives no batch; an empty or unreadable document stays a row, as in the direct read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import ENTRY_SCHEMA

#: Columns of the packed table: the document, and the file it came from.
PACKED = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "path", "document")])


def pack_files(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*.json", files_per_batch: int = 100_000) -> None:
    """Pack the files below ``folder`` that no earlier run with this ``checkpoint`` has packed.

    A batch's rows are dealt to writers by their size (a rebalance, which also splits large ones)."""
    files = (spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder))
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))

    def write(batch: DataFrame, number: int) -> None:
        batch.hint("rebalance").write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_packed(spark: SparkSession, target: str) -> DataFrame:
    """(file, path, document) of all packed files."""
    return spark.read.schema(PACKED).parquet(f"{target.rstrip('/')}/batch=*")


def packed_entries(spark: SparkSession, target: str) -> DataFrame:
    """The result documents of a packed folder, with the columns and rows of ``readers.read_entries``; but
    an object among ``checks_performed`` is its JSON text without the file's line breaks and indents."""
    parsed = read_packed(spark, target).select(F.from_json("document", ENTRY_SCHEMA).alias("entry"), "file", "path")
    return parsed.select("entry.*", "file", "path")
