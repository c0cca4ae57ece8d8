"""Embedding match score per pair: greedy best cosine per token, both ways.

Input: a token table ``(pair keys..., side in {'ref','cand'}, tok_id, vec)``;
the encoder is outside (its vectors are the input, or see ``encode_tokens``).
Precision averages, over candidate tokens, the best cosine against any
reference token; recall the reverse; F1 = 2PR/(P+R), F3 = 10PR/(9P+R); all
rounded to 4 places; null when a side is empty.

Plan (blocked, exact):
1. each side of each pair is cut into blocks of at most ``block`` tokens
   (``groupBy(pair, side, tok_id div block)`` -> bounded arrays);
2. candidate blocks join reference blocks on the pair key: one row per block
   pair, so no row ever holds a whole side and a large pair becomes many
   independent tasks (AQE splits a skewed pair key further);
3. per block pair, one normalised matrix product (numpy, inside
   ``mapInPandas``) gives each token's best match in that block, for both
   directions at once;
4. ``max`` per token over blocks, ``avg`` per pair and side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

BLOCK = 256


def _blocks(t: DataFrame, keys: list[str], side: str, block: int) -> DataFrame:
    s = t.filter(F.col("side") == side)
    return s.groupBy(*keys, F.floor(F.col("tok_id") / block).alias(f"_{side}_blk")).agg(
        F.collect_list("tok_id").alias(f"{side}_ids"),
        F.collect_list(F.transform("vec", lambda x: x.cast("double"))).alias(f"{side}_vecs"),
    )


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero, so its similarity is 0 with any other."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _best_in_block(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            c = np.asarray(np.stack(row.cand_vecs), dtype=np.float64)
            r = np.asarray(np.stack(row.ref_vecs), dtype=np.float64)
            sim = _unit(c) @ _unit(r).T
            key = {k: getattr(row, k) for k in keys}
            out.append(pd.DataFrame({**key, "side": "cand", "tok_id": np.asarray(row.cand_ids, dtype=np.int64),
                                     "best": sim.max(axis=1)}))
            out.append(pd.DataFrame({**key, "side": "ref", "tok_id": np.asarray(row.ref_ids, dtype=np.int64),
                                     "best": sim.max(axis=0)}))
        if out:
            yield pd.concat(out, ignore_index=True)


def embedding_match(tokens: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    ship_package(tokens.sparkSession)
    keys = list(keys)
    t = tokens.select(*keys, "side", F.col("tok_id").cast("long").alias("tok_id"), "vec")
    pairs = _blocks(t, keys, "cand", block).join(_blocks(t, keys, "ref", block), keys)
    key_fields = [f for f in t.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("side", T.StringType()), T.StructField("tok_id", T.LongType()),
        T.StructField("best", T.DoubleType()),
    ])
    best = pairs.mapInPandas(lambda it: _best_in_block(it, keys), out_schema)
    per_tok = best.groupBy(*keys, "side", "tok_id").agg(F.max("best").alias("best"))
    per_side = per_tok.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "cand", F.col("best"))).alias("p"),
        F.avg(F.when(F.col("side") == "ref", F.col("best"))).alias("r"),
    )
    P, R = F.col("p"), F.col("r")
    f1 = F.when(P + R != 0, 2 * P * R / (P + R)).otherwise(F.lit(0.0))
    f3 = F.when(9 * P + R != 0, 10 * P * R / (9 * P + R)).otherwise(F.lit(0.0))
    return per_side.select(
        *keys,
        F.round(P, 4).alias("precision"),
        F.round(R, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round(f3, 4).alias("f3"),
    )


def encode_tokens(texts: DataFrame, encoder: Callable[[list[str]], list[list[list[float]]]],
                  keys: Sequence[str], side_col: str, text_col: str) -> DataFrame:
    """Token vectors from a user-supplied encoder (texts -> per-text token
    vectors), run per Arrow batch with ``mapInPandas``; rows are
    ``(keys, side, tok_id, vec)`` ready for ``embedding_match``."""
    keys = list(keys)
    given = texts.select(*keys, F.col(side_col).alias("side"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([f for f in given.schema.fields if f.name != "_text"] + [
        T.StructField("vecs", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for pdf in batches:
            vecs = encoder(pdf["_text"].tolist())
            yield pdf.drop(columns="_text").assign(vecs=[np.asarray(v, dtype=np.float64).tolist() for v in vecs])

    return given.mapInPandas(run, schema).select(*keys, "side", F.posexplode("vecs").alias("tok_id", "vec")).withColumn(
        "tok_id", F.col("tok_id").cast("long"))
