"""Sentence BLEU-4 with smoothing method 3 over a table of pairs.

Plan per pair table: the texts are hash-partitioned on the pair key and sorted by it, tokens (F7)
are cut from them, and a small helper inside ``mapInArrow`` counts the 1..4-grams of both sides pair
by pair. It gives the four clipped counts (for each gram the least of the two sides), so no n-gram
is ever a row: what is shuffled and spilled is texts, and a task holds the grams of one pair. The
formula follows as columns. Pairs with fewer than four tokens on a side count nothing (score 0).

Where many samples share their task's reference (``bleu_against``), a task's samples are dealt in
shares, a copy of the reference leads each share, and its grams are counted once for all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import ship_package

MAX_N = 4
GRAM_SEP = "\u0001"
MIN_TOKENS = 4
#: Samples of a task that one copy of its reference serves, on average.
SHARE = 256
NUMS = [f"num{n}" for n in range(1, MAX_N + 1)]


def _shifted(arr: Column) -> Column:
    """Row i of the result holds tokens i..i+3 (null past the end): the four
    shifted copies of the token array zipped together."""
    return F.arrays_zip(*[F.slice(arr, k, F.size(arr)).alias(f"w{k}") for k in range(1, MAX_N + 1)])


def bleu_formula(num: Sequence[Column], c_len: Column, r_len: Column) -> Column:
    """Smoothing method 3: the i-th zero numerator gets 1 / (2^i * den)."""
    logs = []
    zeros_before = F.lit(0)
    for n, num_n in enumerate(num, start=1):
        den = F.greatest(c_len - (n - 1), F.lit(1)).cast("double")
        inc = zeros_before + 1
        p = F.when(num_n > 0, num_n.cast("double") / den).otherwise(
            F.lit(1.0) / (F.pow(F.lit(2.0), inc) * den)
        )
        logs.append(F.log(p))
        zeros_before = zeros_before + F.when(num_n == 0, 1).otherwise(0)
    s = logs[0] * 0.25
    for x in logs[1:]:
        s = s + x * 0.25
    bp = F.when(c_len > r_len, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - r_len.cast("double") / c_len))
    return F.when(num[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(s))


def _add_grams(counts: list[Counter], toks: list[str]) -> None:
    for n, own in enumerate(counts, 1):
        own.update(zip(*(toks[i:] for i in range(n))))


def _clipped(c: list[Counter], r: list[Counter]) -> list[int]:
    return [sum(min(x, own[g]) for g, x in of.items() if g in own) for of, own in zip(c, r)]


def _no_grams() -> list[Counter]:
    return [Counter() for _ in range(MAX_N)]


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))  # NaN is one key


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))


def _out(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of some thousand rows."""
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _pair_counts(rows: Iterator[tuple], n_keys: int) -> Iterator[tuple]:
    """Rows (keys, unscored, reference's tokens, candidate's) sorted by keys -> keys, unscored, short,
    the most tokens of either side, clipped counts. Rows of one key add up."""
    now, sides = None, None
    for row in rows:
        key, (unscored, rt, ct) = row[:n_keys], row[n_keys:]
        if now is None or not _same(now, key):
            if now is not None:
                yield (*now, *seen, *_clipped(*sides))
            now, sides, seen = key, (_no_grams(), _no_grams()), [False, False, 0, 0]
        seen = [seen[0] or unscored, seen[1], max(seen[2], len(rt)), max(seen[3], len(ct))]
        if unscored or len(rt) < MIN_TOKENS or len(ct) < MIN_TOKENS:
            seen[1] = True
        else:
            _add_grams(sides[0], ct)
            _add_grams(sides[1], rt)
    if now is not None:
        yield (*now, *seen, *_clipped(*sides))


def _sample_counts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (share, of a sample, columns, tokens) in the order of shares, each led by its task's reference
    where it has one -> the samples' columns, the reference's tokens (null: none), their own, clipped counts.
    Rows with the same columns add up."""
    led, now = None, None
    for share, of_sample, *cols, toks in rows:
        if not of_sample:
            if now is not None:
                yield (*now, r_len, c_len, *_clipped(c, r))
            if led is None or not _same(led, share):
                led, r, r_len = share, _no_grams(), 0
            now, r_len = None, r_len + len(toks)
            if len(toks) >= MIN_TOKENS:
                _add_grams(r, toks)
            continue
        if now is None or not _same(now, tuple(cols)):
            if now is not None:
                yield (*now, r_len, c_len, *_clipped(c, r))
            if led is None or not _same(led, share):
                led, r, r_len = share, _no_grams(), None
            now, c, c_len = tuple(cols), _no_grams(), 0
        c_len += len(toks)
        if len(toks) >= MIN_TOKENS:
            _add_grams(c, toks)
    if now is not None:
        yield (*now, r_len, c_len, *_clipped(c, r))


def _counted(rows: DataFrame, count, keys: list[str], *more: T.StructField) -> DataFrame:
    """``count`` over the rows of each partition: ``keys``, ``more`` and the four clipped counts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(rows.sparkSession)
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], *more, *[T.StructField(n, T.LongType()) for n in NUMS]])
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: _out(count(_rows(batches)), arrow), schema)


def bleu(pairs: DataFrame, keys: Sequence[str], ref_col: str, cand_col: str) -> DataFrame:
    """One row per pair: ``keys``, token counts and ``bleu``.

    ``bleu`` is null when the reference is empty (not scored), 0 when either
    side has fewer than four tokens.

    The pair rows (texts) are hash-partitioned on the pair key once and sorted by it; tokens are cut
    after the sort, so only texts are shuffled or spilled. Rows of one key are scored as one.
    """
    keys = list(keys)
    n_keys = len(keys)
    t = pairs.repartition(*keys).sortWithinPartitions(*keys).select(
        *keys, (F.coalesce(F.col(ref_col), F.lit("")) == "").alias("_unscored"), tokens(ref_col).alias("_rt"), tokens(cand_col).alias("_ct"))
    per_pair = _counted(
        t, lambda rows: _pair_counts(rows, n_keys), keys, T.StructField("_unscored", T.BooleanType()), T.StructField("_short", T.BooleanType()),
        T.StructField("ref_tokens", T.IntegerType()), T.StructField("cand_tokens", T.IntegerType()))
    score = bleu_formula([F.col(n) for n in NUMS], F.col("cand_tokens"), F.col("ref_tokens"))
    return per_pair.select(
        *keys, "ref_tokens", "cand_tokens",
        F.when(F.col("_unscored"), F.lit(None).cast("double"))
        .when(F.col("_short"), F.lit(0.0))
        .otherwise(score).alias("bleu"),
    )


def _gram_counts(rows: DataFrame, cols: Sequence[str], n_tokens: str, toks: str, count: str) -> DataFrame:
    """``cols``, n, g and how often the row group has that n-gram. Every row also gives a marker
    (n = 0) that counts its tokens; rows with fewer than four tokens give nothing else."""
    shifted = F.when(F.col(n_tokens) >= MIN_TOKENS, _shifted(F.col(toks)))
    e = rows.select(*cols, n_tokens, F.posexplode_outer(shifted).alias("_p", "_z"))
    w = [F.col(f"_z.w{k}") for k in range(1, MAX_N + 1)]
    own = [F.when(w[n - 1].isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(GRAM_SEP, *w[:n]).alias("g"), F.lit(1).alias("x")))
           for n in range(1, MAX_N + 1)]
    first = F.coalesce(F.col("_p"), F.lit(0)) == 0
    marker = F.when(first, F.struct(F.lit(0).alias("n"), F.lit("").alias("g"), F.col(n_tokens).alias("x")))
    g = e.select(*cols, F.explode(F.array(marker, *own)).alias("_x")).filter(F.col("_x").isNotNull())
    return g.groupBy(*cols, F.col("_x.n").alias("n"), F.col("_x.g").alias("g")).agg(F.sum("_x.x").alias(count))


def reference_index(refs: DataFrame, task: str, ref_col: str) -> DataFrame:
    """(task, n, g, r): the n-gram counts of every task's reference, and its tokens as n = 0. Tasks
    with an empty reference aren't listed. One reference per task."""
    t = refs.filter(F.coalesce(F.col(ref_col), F.lit("")) != "").select(task, tokens(ref_col).alias("_rt"))
    return _gram_counts(t.withColumn("ref_tokens", F.size("_rt")), [task], "ref_tokens", "_rt", "r")


def bleu_against(samples: DataFrame, refs: DataFrame, keys: Sequence[str], task: str, ref_col: str, cand_col: str) -> DataFrame:
    """``bleu`` of samples against their task's reference: ``keys``, token counts and ``bleu``, with the
    same values as ``bleu`` over the joined texts (null without a reference).

    A task with more than ``SHARE`` samples is dealt in shares of about that many, by a hash of the
    sample's key; each share gets a copy of the reference, sorted before its samples. A reference is so
    copied once for every ``SHARE`` samples at most, a hot task spreads over many partitions, and
    only texts are shuffled or spilled. The clipped counts of a key are summed at the end.
    """
    keys = list(keys)
    cols = keys if task in keys else [*keys, task]
    hot = samples.groupBy(task).count().where(F.col("count") > SHARE).select(F.col(task).alias("_hot"), F.ceil(F.col("count") / SHARE).cast("int").alias("_shares"))
    shares = F.coalesce("_shares", F.lit(1))
    s = samples.select(*cols, cand_col).join(hot, F.col(task).eqNullSafe(F.col("_hot")), "left")
    s = s.select(F.pmod(F.xxhash64(*keys), shares).cast("int").alias("_share"), F.lit(True).alias("_of_sample"), *cols, F.col(cand_col).alias("_text"))
    r = refs.filter((F.coalesce(F.col(ref_col), F.lit("")) != "") & F.col(task).isNotNull()).select(task, F.col(ref_col).alias("_text"))
    r = r.join(hot, F.col(task) == F.col("_hot"), "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    own = [F.col(c) if c == task else F.lit(None).cast(s.schema[c].dataType).alias(c) for c in cols]
    led = r.select("_share", F.lit(False).alias("_of_sample"), *own, "_text").unionByName(s)
    led = led.repartition(task, "_share").sortWithinPartitions(task, "_share", "_of_sample", *cols)
    t = led.select(F.struct(task, "_share").alias("_led"), "_of_sample", *cols, tokens("_text").alias("_toks"))
    counts = _counted(t, lambda rows: _sample_counts(((tuple(x[0].values()), *x[1:]) for x in rows)), cols,
                      T.StructField("r", T.LongType()), T.StructField("c", T.LongType()))
    per = counts.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in NUMS], F.max("r").cast("int").alias("ref_tokens"), F.max("c").cast("int").alias("cand_tokens"))
    scored = F.col("ref_tokens").isNotNull()
    short = (F.col("ref_tokens") < MIN_TOKENS) | (F.col("cand_tokens") < MIN_TOKENS)
    score = bleu_formula([F.col(n) for n in NUMS], F.col("cand_tokens"), F.col("ref_tokens"))
    return per.select(
        *keys, F.coalesce("ref_tokens", F.lit(0)).alias("ref_tokens"), "cand_tokens",
        F.when(scored, F.when(short, F.lit(0.0)).otherwise(score)).alias("bleu"),
    )
