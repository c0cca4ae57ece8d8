"""Running totals that stay distributed (W1 running progress).

A plain ``Window.partitionBy(run).orderBy(seq)`` puts every row of a run into
one task; a run holding a third of all rows would then be one task. Instead
the rows are cut into blocks of equally many rows by their order:

1. rows in blocks                            -- range partitioning by (run, key), written once
2. per (run, block) count and sum            -- partial aggregate, tiny output
3. prefix over blocks per run                -- window over rows / rows-per-block rows
4. per (run, block) window over the block's rows, plus the block offset

A block's bounds are order statistics of (run, key), which Spark samples, so its size depends on
the number of rows alone: sparse keys, clusters of times and outliers give the blocks that dense
keys give. With the default of 2^18 rows a block, 10^12 rows need about 4M block rows, and a run
holding a third of them 1.3M. The written table fixes every row's block, whatever is computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir


def ordered_blocks(df: DataFrame, run_col: str, order_col: str, rows_per_block: int) -> DataFrame:
    """The rows with their block ``_blk``: about ``rows_per_block`` rows that follow each other by
    (run, key). Rows equal in both share a block."""
    blocks = max(1, -(-df.count() // rows_per_block))
    placed = df.repartitionByRange(blocks, run_col, order_col).withColumn("_blk", F.spark_partition_id().cast("long"))
    path = scratch_dir(df.sparkSession, "running-blocks")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def running_sum(
    df: DataFrame,
    run_col: str,
    order_col: str,
    value_col: str,
    block_width: int | None = None,
    rows_per_block: int = 1 << 18,
) -> DataFrame:
    """Add ``seq`` (1-based position in run), ``running_value`` and ``run_rows``.

    Ties are broken by ``order_col`` only, so it should be unique within a run (as an id is).
    With a ``block_width`` (integral keys) blocks are cut by key distance instead, without a written table.
    """
    if block_width is None:
        tagged = ordered_blocks(df, run_col, order_col, rows_per_block)
    else:
        tagged = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block_width)).cast("long"))
    blocks = tagged.groupBy(run_col, "_blk").agg(
        F.count(F.lit(1)).alias("_bn"), F.sum(F.col(value_col)).alias("_bs")
    )
    prior = Window.partitionBy(run_col).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(run_col)
    offsets = blocks.select(
        run_col,
        "_blk",
        F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_bs").over(prior), F.lit(0)).alias("_s_before"),
        F.sum("_bn").over(whole).alias("run_rows"),
    )
    ordered = Window.partitionBy(run_col, "_blk").orderBy(order_col)
    inner = ordered.rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(offsets, [run_col, "_blk"])
    return joined.select(
        *df.columns,
        (F.col("_n_before") + F.row_number().over(ordered)).alias("seq"),
        (F.col("_s_before") + F.sum(value_col).over(inner)).alias("running_value"),
        "run_rows",
    )


def running_progress(
    df: DataFrame,
    run_col: str,
    order_col: str,
    duration_col: str,
    block_width: int | None = None,
    units_per_second: float = 1.0,
    rows_per_block: int = 1 << 18,
) -> DataFrame:
    """Elapsed so far, average per sample, ETA for the rest, percent done.

    Pass durations as integer ticks (e.g. centiseconds with
    ``units_per_second=100``) to get exact, order-independent running sums.
    """
    r = running_sum(df, run_col, order_col, duration_col, block_width, rows_per_block)
    elapsed = F.col("running_value") / F.lit(float(units_per_second))
    avg = elapsed / F.col("seq")
    remaining = F.col("run_rows") - F.col("seq")
    return r.select(
        *df.columns,
        "seq",
        elapsed.alias("elapsed_s"),
        avg.alias("avg_per_sample_s"),
        remaining.alias("remaining"),
        (avg * remaining).alias("eta_s"),
        (F.lit(100.0) * F.col("seq") / F.col("run_rows")).alias("pct_done"),
        "run_rows",
    )
