"""Text operators over a corpus: token ids, token counts, sentence spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.sentences import sentences
from ledgerloom.llm.transducer import tokenizer

#: Characters of text taken together in a worker; a longer text stands alone.
CHUNK_CHARS = 2_000_000


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sizes = pd.Series([len(x) if x else 0 for x in b["text"]], index=b.index).cumsum() // CHUNK_CHARS
        for _, part in b.groupby(sizes, sort=False):
            yield part


def encode(df: DataFrame, id_: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row's text; null and empty texts have an empty list.

    folder: where the vocabulary files lie on every executor; the installed public_tokenizers if None.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(name, folder)
        for part in _chunks(batches):
            yield pd.DataFrame({"id": part["id"], "ids": [t.encode(x) for x in part["text"]]})

    kind = df.schema[id_].dataType.simpleString()
    out = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_), "ids")


def decode(df: DataFrame, id_: str, ids: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, text): texts from token ids; null ids give null, none give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(name, folder)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [t.decode(x) for x in b["ids"]]})

    kind = df.schema[id_].dataType.simpleString()
    out = df.select(F.col(id_).alias("id"), F.col(ids).alias("ids")).mapInPandas(run, f"id {kind}, text string")
    return out.select(F.col("id").alias(id_), "text")


def count_tokens(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns of `keep` and n_tokens, 0 for null and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(name, folder)
        for part in _chunks(batches):
            yield part.drop(columns="text").assign(n_tokens=[len(t.encode(x)) for x in part["text"]])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("text")).mapInPandas(run, f"{fields}, n_tokens int")


def sentence_spans(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, start_char, end_char) of every sentence, in code points; no rows for texts without visible characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(batches):
            spans = [sentences(x) for x in part["text"]]
            flat = np.array([v for x in spans for v in x], dtype="int32").reshape(-1, 2)
            yield pd.DataFrame({"id": part["id"].repeat([len(x) for x in spans]).to_numpy(), "start_char": flat[:, 0], "end_char": flat[:, 1]})

    kind = df.schema[id_].dataType.simpleString()
    out = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, start_char int, end_char int")
    return out.select(F.col("id").alias(id_), "start_char", "end_char")
