"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only.

Long and short texts are cut at safe boundaries (see ``pieces``), the library encodes batches of
pieces balanced by bytes, and only numbers leave the worker. No shuffle, memory bounded by one
Arrow batch (4 MB) and a table of bounded size.

Defined results: null counts as empty (0 bytes, 0 tokens); special strings in a text are handled
as the library does by default; repeated rows get equal counts; other columns are kept, and a
column that has the name of a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chunks, limit_batches, text_buffer
from veilframe.llm.pieces import piece_table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048


def token_count(text: str | Column, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of each text, without begin, end or other added tokens."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        raw, at = text_buffer(texts)
        table = piece_table(tokenizer, False)
        parts = [table.texts(raw[at[b] : at[e]], at[b : e + 1] - at[b])[0] for b, e in chunks(at)]
        return pa.array(np.concatenate(parts) if parts else [], pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """The rows with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    limit_batches(docs.sparkSession)
    counted = docs.withColumns({
        "n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
        "n_tokens": token_count(text_col, tokenizer),
    })
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
