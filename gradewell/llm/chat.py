"""Conversations formatted by a chat template, with a loss mask aligned by token offsets.

Each turn becomes ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is put
before every backslash and between ``<`` and ``|``, so no control string can occur in them and
every text reads back exactly. The whole conversation is rendered, then encoded once with offsets;
the tokens of an assistant's turn are those whose span meets the turn's span, found by binary
search in the sorted offsets and clipped to it.

Conversations are hash-partitioned and sorted by turn, and read as a stream: memory holds one
conversation. Rows are ordered by turn (nulls first), then role and text; repeated turns stay.
Null roles and texts are empty; null ids form one conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and each text's place in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        out += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for turn in formatted.split(TURN)[1:]:
        role, _, text = turn.partition(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tokens under the mask, and the characters they cover inside the spans, as runs."""
    mask = np.zeros(len(offsets), dtype=bool)
    covered: list[tuple[int, int]] = []
    for a, b in spans:
        if a == b:
            continue
        first = int(np.searchsorted(offsets[:, 1], a, side="right"))
        stop = int(np.searchsorted(offsets[:, 0], b, side="left"))
        mask[first:stop] = True
        fresh = True
        for x, y in offsets[first:stop].clip(a, b).tolist():
            if not fresh and x <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(covered[-1][1], y))
            else:
                covered.append((x, y))
                fresh = False
    return mask, covered


def _encoder(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    encoder = Tokenizer.from_file(vocabulary)
    encoder.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (TURN, TEXT, END)])
    return encoder


def format_conversations(
    rows: DataFrame, vocabulary: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_role: str = "assistant", batch_chars: int = 1_000_000,
) -> DataFrame:
    """One row per conversation: id, n_turns, formatted, token_ids, loss_mask (per token), loss_spans
    (character runs under the mask, start and stop in turn)."""
    turns = rows.select(
        F.col(id_col), F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text")
    )
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema[id_col].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
            T.StructField("loss_spans", T.ArrayType(T.IntegerType())),
        ]
    )

    def encode(encoder, waiting):
        made = [render(turns) for _, turns in waiting]
        columns = [[], [], [], [], [], []]
        for (key, turns), (text, spans), got in zip(waiting, made, encoder.encode_batch([t for t, _ in made], add_special_tokens=False)):
            offsets = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
            mask, covered = masked(offsets, [s for s, (role, _) in zip(spans, turns) if role == loss_role])
            for column, x in zip(columns, (key, len(turns), text, got.ids, mask, [x for s in covered for x in s])):
                column.append(x)
        types = [None, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
        return columns, types

    def form(batches):
        encoder = _encoder(vocabulary)
        waiting: list[tuple[object, list[tuple[str, str]]]] = []
        chars, id_type = 0, None

        def flush():
            columns, types = encode(encoder, waiting)
            types[0] = id_type
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if not waiting or waiting[-1][0] != key:
                    if chars >= batch_chars:  # all that wait are whole
                        yield flush()
                        chars = 0
                    waiting.append((key, []))
                waiting[-1][1].append((role, text))
                chars += len(text)
        if waiting:
            yield flush()

    return turns.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text").mapInArrow(form, schema)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the mask, read from the formatted output."""
    schema = T.StructType(
        [
            T.StructField(id_col, formatted.schema[id_col].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def read(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2]))
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
                out.append((len(turns), digests[0], len(loss), digests[1], len(text)))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, types))], names=schema.names
            )

    return formatted.select(id_col, "formatted", "loss_spans").mapInArrow(read, schema)


def hard_case(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -7: a user and an assistant who both say another template's control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return two.select(*[F.col(c).cast(like.schema[c].dataType) for c in two.columns])
