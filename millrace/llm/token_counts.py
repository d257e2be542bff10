"""Token counts: batches balanced by bytes go through the library, only lengths come back."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import chunks_by_bytes, ship, trim

#: Bytes of text that one library call gets.
BATCH_BYTES = 1 << 20
#: A longer text is cut, in characters.
PIECE_CHARS = 1 << 16
#: A single space between two ASCII letters always starts a new pre-token, so a
#: text may be cut before it; the special token's string holds no such place.
_SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once for each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe places into parts of about ``limit`` characters.

    A stretch without a safe place stays whole, whatever its length.
    """
    out, a = [], 0
    while len(text) - a > limit:
        m = _SAFE.search(text, a + limit)
        if not m:
            break
        out.append(text[a : m.end()])
        a = m.end()
    out.append(text[a:])
    return out


def _count(path: str, texts: list[str]) -> np.ndarray:
    parts, owner = [], []
    for i, t in enumerate(texts):
        for p in pieces(t):
            parts.append(p)
            owner.append(i)
    tok, sums = tokenizer(path), np.zeros(len(texts), np.int64)
    for a, b in chunks_by_bytes([len(p) for p in parts], BATCH_BYTES):
        np.add.at(sums, owner[a:b], [len(e) for e in tok.encode_batch_fast(parts[a:b], add_special_tokens=False)])
    return sums


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the token count of a text column; all other columns stay.

    A null text counts as empty (0).  Rows are neither merged nor moved, so
    repeated rows each get their count; an empty table stays empty.  A column
    already named ``out`` is replaced.
    """
    ship(df.sparkSession)
    df = df.drop(out) if out in df.columns and out != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            counts = pa.array(_count(path, texts), pa.int64())
            trim()
            yield pa.RecordBatch.from_arrays([*b.columns, counts], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def op5_query(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = count_tokens(rows, path)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
