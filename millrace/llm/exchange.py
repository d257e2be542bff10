"""Which keys of a bucket occur in other buckets too: an exchange of packed keys.

Each bucket sends its distinct keys, sorted, to the owners of their ranges; an
owner sorts what it has got, compares neighbours, and answers every bucket with
a bit mask over the keys it sent.  A key travels once from a bucket, however
often it occurs there, so a hot key costs one entry for each bucket that has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import bucket_count, checkpoint, from_blocks, pack_sorted, packed_documents, release, squeeze, unpack_sorted, unsqueeze

#: Bytes of stored input in a bucket; a task holds several arrays of its text's length.
STORED_BYTES = 2 << 20
SENT = "owner int, bucket int, payload binary"
REPLY = "bucket int, owner int, grade binary, first binary"


def stored_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of ``(doc_id, text)`` in the shared folder, each bucket's in one partition.

    The checkpoint keeps the partitioning, so later steps by bucket move only
    what they exchange, not the text.
    """
    spark, n = docs.sparkSession, bucket_count(docs, STORED_BYTES)
    # a plan that adapts while it runs doesn't say how its result is partitioned
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = checkpoint(packed_documents(docs, n).repartition(n, "bucket"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    release(spark)
    return stored, n


def bucket_documents(t: pa.Table) -> pa.Table:
    """The documents of a bucket, in an order that doesn't depend on arrival."""
    return from_blocks(t.column("payload").to_pylist()).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _slices(keys: np.ndarray, bits: int, owners: int) -> list[tuple[int, int, int]]:
    """(owner, from, to) for sorted keys of ``bits`` bits."""
    if not len(keys):
        return []
    at = ((keys >> np.uint64(max(bits - 32, 0))) * np.uint64(owners)) >> np.uint64(min(bits, 32))
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return list(zip(at[starts].astype(int).tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))


def send(bucket: int, keys: np.ndarray, bits: int, owners: int) -> pa.Table:
    """Messages for sorted distinct keys."""
    parts = _slices(keys, bits, owners)
    return pa.table({"owner": pa.array([o for o, _, _ in parts], pa.int32()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "payload": pa.array([pack_sorted(keys[a:z]) for _, a, z in parts], pa.binary())})


def _answer(key, t):
    held = [unpack_sorted(b) for b in t.column("payload").to_pylist()]
    order = np.argsort(np.array(t.column("bucket").to_pylist()), kind="stable")
    keys = np.concatenate([held[i] for i in order])
    by = np.argsort(keys, kind="stable")
    ranked = keys[by]
    same = ranked[1:] == ranked[:-1]
    runs = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[runs, len(keys)])
    grade, first = np.empty(len(keys), np.uint8), np.zeros(len(keys), bool)
    grade[by] = np.repeat(np.log2(sizes).astype(np.uint8), sizes)
    first[by[runs]] = True
    out, a = [None] * len(held), 0
    for i in order:
        z = a + len(held[i])
        out[i] = (squeeze(grade[a:z].tobytes()), squeeze(np.packbits(first[a:z]).tobytes()))
        a = z
    return pa.table({"bucket": t.column("bucket").cast(pa.int32()), "owner": t.column("owner").cast(pa.int32()), "grade": pa.array([x[0] for x in out], pa.binary()), "first": pa.array([x[1] for x in out], pa.binary())})


def answers(sent: DataFrame) -> DataFrame:
    """The owners' replies, stored."""
    return checkpoint(sent.groupBy("owner").applyInArrow(_answer, REPLY))


def masks(replies: pa.Table, keys: np.ndarray, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted distinct key that was sent: the binary logarithm of the
    number of buckets that have it (0: this one alone), and whether this bucket
    is the first of them."""
    grade, first = np.zeros(len(keys), np.uint8), np.ones(len(keys), bool)
    parts = {o: (a, z) for o, a, z in _slices(keys, bits, owners)}
    for r in replies.to_pylist():
        a, z = parts[r["owner"]]
        grade[a:z] = np.frombuffer(unsqueeze(r["grade"]), np.uint8)
        first[a:z] = np.unpackbits(np.frombuffer(unsqueeze(r["first"]), np.uint8), count=z - a)
    return grade, first
