"""Token files: ids at the fewest bits the vocabulary needs, in blocks with offsets.

Format, one row a block, in Parquet files that Spark commits: ``shard`` and
``block`` give the order; ``base`` is the number of ids of the shard before the
block, ``n_ids`` its own; ``bits`` the width of an id; ``doc_ids`` and ``ends``
(little-endian int64) name its documents and where each ends; ``payload`` holds
the ids, ``bits`` wide, little-endian bit order.  Id ``i`` starts at bit
``i * bits``, so any range can be read without what is before it.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bucket_count, chunks_by_bytes, from_blocks, ordered_blocks, shared_folder
from millrace.llm.token_counts import tokenizer
from millrace.llm.word_bpe import CachedEncoder

#: Ids that a block holds at least (a document is never cut).
BLOCK_IDS = 1 << 18
#: Appended to every document.
END_ID = 1
BLOCK_SCHEMA = "shard int, block int, base long, n_ids long, bits int, doc_ids binary, ends binary, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for a in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends at a byte
        part = ids[a : a + (1 << 16)].astype(np.uint64)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(payload: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` (exclusive), from their own bytes alone."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", end - start, start * bits // 8).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, (end * bits + 7) // 8 - first, first)
    flat = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: (end - start) * bits]
    return (flat.reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def _write(path: str, bits: int):
    def run(key, t):
        docs = from_blocks(t.column("payload").to_pylist())
        docs = docs.take(pc.sort_indices(docs, [("key", "ascending"), ("text", "ascending")]))
        encoder, rows, base = CachedEncoder.of(path), [], 0
        held, ids, size = [], [], 0

        def close():
            nonlocal base, held, ids, size
            if held:
                all_ids = np.concatenate(ids)
                rows.append((key[0].as_py(), len(rows), base, size, bits, np.array(held, "<i8").tobytes(), np.cumsum([len(x) for x in ids]).astype("<i8").tobytes(), pack_bits(all_ids, bits)))
                base, held, ids, size = base + size, [], [], 0

        keys, texts = docs.column("key").to_pylist(), docs.column("text").to_pylist()
        for a, z in chunks_by_bytes([len(x) for x in texts], 1 << 20):
            for k, x in zip(keys[a:z], encoder.many(texts[a:z]), strict=True):
                x = np.append(x, x.dtype.type(END_ID))
                held.append(k)
                ids.append(x)
                size += len(x)
                if size >= BLOCK_IDS:
                    close()
        close()
        names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


#: The key of a row without a doc_id: before all others.
NO_ID = -(1 << 63)


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Encode ``docs (doc_id, text, ...)`` and write the files in ascending doc_id order.

    Null texts are empty (only the end id).  Rows of one doc_id follow each other
    by text; rows without a doc_id come first.  An empty table writes no block.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = max(1, (tokenizer(path).get_vocab_size() - 1).bit_length())
    blocks = ordered_blocks(rows, bucket_count(docs, 8 << 20))
    blocks.groupBy("bucket").applyInArrow(_write(path, bits), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)


def _read(batches):
    for b in batches:
        out = {k: [] for k in ("shard", "key", "at", "n", "crc")}
        for r in b.to_pylist():
            ends = np.frombuffer(r["ends"], "<i8")
            for k, a, z in zip(np.frombuffer(r["doc_ids"], "<i8").tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                ids = unpack_bits(r["payload"], r["bits"], a, z)
                for name, v in zip(out, (r["shard"], k, r["base"] + a, z - a, crc32(ids.tobytes())), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("key", "at", "n", "crc"))], list(out))


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files, as unpacked."""
    own = files.select("shard", "bits", "base", "doc_ids", "ends", "payload").mapInArrow(_read, "shard int, key long, at long, n long, crc long")
    before = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return own.join(before, "shard").select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op8_query(docs: DataFrame, path: str) -> DataFrame:
    """Write the token files of documents below the shared folder, and read them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder)
    return read_tokens(docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(folder))
