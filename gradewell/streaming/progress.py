"""ST1: incremental pass@k while results arrive.

Results land as files; a file stream feeds the per-task counts (A1), kept by
Structured Streaming state on disk (RocksDB). Each micro-batch writes the counts
of the tasks it changed; pass@k (A2) and macro averages (A3) are derived from the
newest counts of every task, a table that stays with the executors. Re-delivered
results are dropped by key, however late they come: keys don't expire.

Where results are replaced (S8: an entry that is run again), ``changes_stream`` keeps the newest
version of every entry in state and gives what a newer one changes: the old outcome taken back
from its task's counts, the new one added. Entries are kept in pages (a hash of the key), so that
Python is called once for a page and not for every entry. Each micro-batch writes the sums of its
changes by task; ``counts_from_changes`` adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.passk import K_VALUES, pass_at_k
from ..operators.metrics import METRICS, macro_average, truthy
from ..session import scratch_dir

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def task_counts_stream(samples: DataFrame, key: str | None = None) -> DataFrame:
    """Streaming A1 counts per task; ``key`` de-duplicates re-delivered rows."""
    s = samples if key is None else samples.dropDuplicates([key])
    return s.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(truthy(f"{m}_ok")).alias(f"c_{m}") for m in METRICS],
    )


COUNTS = ["n", *(f"c_{m}" for m in METRICS)]
CHANGE = T.StructType([T.StructField("task_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])
OKS = [f"ok_{m}" for m in METRICS]
#: A page of entries: one array per field, in the order of the keys.
PAGE = T.StructType([
    T.StructField("key", T.ArrayType(T.StringType())), T.StructField("version", T.ArrayType(T.LongType())),
    T.StructField("task_id", T.ArrayType(T.StringType())), *(T.StructField(c, T.ArrayType(T.LongType())) for c in (*OKS, "seen_ms")),
])
#: Version of a row without one: older than all others.
UNVERSIONED = -(1 << 63)


def _order(entry: tuple) -> tuple:
    """Entries by version; of equal versions the greater outcome, whatever came first."""
    version, task, *oks = entry
    return version, task is not None, task or "", oks


def _replace(page: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest version of each entry goes into the page; the changes to the counts come out, summed by task."""
    newest = {k: ((version, task, *oks), seen) for k, version, task, *oks, seen in zip(*state.get)} if state.exists else {}
    old = {}
    for part in parts if not state.hasTimedOut else ():
        # only keys and tasks may be null; the work of a page is kept to plain lists
        texts = ([x if isinstance(x, str) else None for x in part[c].tolist()] for c in ("key", "task_id"))
        for key, task, version, *oks, seen in zip(*texts, *(part[c].tolist() for c in ("version", *OKS, "seen_ms"))):
            row = (version, task, *oks)
            now, seen_before = newest.get(key, (None, 0))
            old.setdefault(key, now)
            newest[key] = (row if now is None or _order(row) > _order(now) else now, max(seen_before, seen))
    sums: dict = {}
    for key, was in old.items():
        for entry, sign in ((was, -1), (newest[key][0], 1)):
            if entry is not None and (was is None or was[1:] != newest[key][0][1:]):
                total = sums.setdefault(entry[1], [0] * len(COUNTS))
                for i, x in enumerate((1, *(ok > 0 for ok in entry[2:]))):
                    total[i] += sign * x
    if any(seen for _, seen in newest.values()):  # only where entries are forgotten
        watermark = state.getCurrentWatermarkMs()
        newest = {k: x for k, x in newest.items() if x[1] >= watermark}
        if newest:
            state.setTimeoutTimestamp(max(watermark, min(seen for _, seen in newest.values())) + 1)
    if newest:
        state.update([list(column) for column in zip(*((k, *entry, seen) for k, (entry, seen) in newest.items()))])
    elif state.exists:
        state.remove()
    if sums:
        yield pd.DataFrame([(task, *total) for task, total in sums.items()], columns=CHANGE.names)


def changes_stream(samples: DataFrame, key: str, version: str, pages: int = 1 << 20, forget_after: str | None = None) -> DataFrame:
    """Changes to the counts per task (task_id, n, c_...) as entries arrive and are replaced.

    The row with the greatest ``version`` (a number or a time) counts for its ``key``, in whatever
    order rows arrive; a repeated or older row changes nothing, and a row that names another task
    moves the entry there. ``pages`` stays the same for a checkpoint's life; one for every 100 entries
    expected keeps a page small. Keys stay in state for good, unless ``forget_after`` (an interval;
    ``version`` must be a time) lets go of those whose newest row is that much older than the newest of
    all. Rows older than that are then ignored; a newer row of a forgotten key counts as another entry.
    """
    kind = samples.schema[version].dataType
    at = F.unix_micros(version) if isinstance(kind, T.TimestampType) else F.col(version).cast("long")
    s = samples.withWatermark(version, forget_after) if forget_after else samples
    s = s.select(
        *([version] if forget_after else []),
        F.pmod(F.xxhash64(key), F.lit(pages)).alias("page"),
        F.col(key).cast("string").alias("key"), F.coalesce(at, F.lit(UNVERSIONED)).alias("version"), "task_id",
        *[F.coalesce(F.col(f"{m}_ok").cast("long"), F.lit(-1)).alias(f"ok_{m}") for m in METRICS],
        (F.coalesce(F.unix_millis(version), F.lit(0)) if forget_after else F.lit(0)).cast("long").alias("seen_ms"),
    )
    timeout = GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    return s.groupBy("page").applyInPandasWithState(_replace, CHANGE, PAGE, "update", timeout)


def changes_sink(path: str):
    """A ``foreachBatch`` function that writes the sums of a micro-batch's changes by task; a replayed
    batch replaces its own rows, so no change counts twice."""

    def _write(changes: DataFrame, batch: int) -> None:
        sums = changes.groupBy("task_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
        sums.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return _write


def counts_from_changes(spark: SparkSession, path: str) -> DataFrame:
    """A1 counts of every task that still has an entry, from what ``changes_sink`` has written."""
    table = spark.read.schema(T.StructType([*CHANGE.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return table.groupBy("task_id").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("n > 0")


def run_changes(spark: SparkSession, changes: DataFrame, sink_path: str, checkpoint: str) -> DataFrame:
    """Drain everything available and return the counts as a batch DataFrame. With the same two
    folders a later run, or one after a failure, goes on where this one ends."""
    with _state_on_disk(spark):
        q = (
            changes.writeStream.outputMode("update")
            .foreachBatch(changes_sink(sink_path))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    return counts_from_changes(spark, sink_path)


def pass_at_k_from_counts(counts: DataFrame) -> DataFrame:
    """A2 over a counts table (batch)."""
    return counts.select(
        "task_id", "n", *[f"c_{m}" for m in METRICS],
        *[pass_at_k("n", f"c_{m}", k).alias(f"pass{k}_{m}") for m in METRICS for k in K_VALUES],
    )


def counts_sink(path: str):
    """A ``foreachBatch`` function that writes the counts each micro-batch changed
    (update mode); a replayed batch replaces its own rows."""

    def _write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return _write


def newest_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest counts of every task written by ``counts_sink``."""
    values = [f.name for f in schema.fields if f.name != "task_id"]
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return table.groupBy("task_id").agg(F.max_by(F.struct(*values), "batch").alias("x")).select("task_id", "x.*")


def run_to_completion(spark: SparkSession, counts_stream: DataFrame, sink_path: str | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """Drain everything available (``availableNow``) through ``counts_sink`` and return
    the newest counts as a batch DataFrame. Both folders lie in the shared checkpoint
    folder unless given; with the same two a later run goes on where this one ends."""
    sink_path = sink_path or scratch_dir(spark, "counts")
    with _state_on_disk(spark):
        q = (
            counts_stream.writeStream.outputMode("update")
            .foreachBatch(counts_sink(sink_path))
            .option("checkpointLocation", checkpoint or scratch_dir(spark, "counts-stream"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    return newest_counts(spark, sink_path, counts_stream.schema)


def run_with_sink(spark: SparkSession, counts_stream: DataFrame, sink_path: str,
                  checkpoint: str | None = None) -> None:
    """Drain available results and write the pass@k table (A2) and its macro averages (A3)."""
    root = sink_path.rstrip("/")
    per_task = pass_at_k_from_counts(run_to_completion(spark, counts_stream, f"{root}/counts", checkpoint))
    per_task.write.mode("overwrite").parquet(f"{root}/per_task")
    macro_average(spark.read.parquet(f"{root}/per_task")).write.mode("overwrite").parquet(f"{root}/summary")
