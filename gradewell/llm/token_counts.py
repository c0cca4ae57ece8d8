"""Token counts by a byte-pair vocabulary compiled to a finite-state transducer (bpe_transducer).

Nulls count as the empty text, which has no tokens. Repeated rows are counted each; an empty
table gives an empty result; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_transducer
from .common import bytes_of, give_back, texts_of, text_or_empty


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its bytes in UTF-8, its tokens, and whether they are more than ``limit``.

    ``vocabulary`` is the path of a tokenizers file that every executor can read. A narrow job:
    each text is read once and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("text"))
    out = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches):
        give_back(tokenizer=True)
        counter = bpe_transducer.counter(vocabulary)
        for batch in batches:
            texts = texts_of(batch)
            tokens = np.zeros(len(texts), dtype=np.int64)
            for a, b in bpe_transducer.slices(texts):
                tokens[a:b] = counter.count(texts[a:b])
            size = pa.array([len(t) for t in bytes_of(batch)], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, out)
