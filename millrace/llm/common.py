"""Shared plumbing: bucket counts, packed row blocks, key exchange, ordered buckets.

Wide text is moved between tasks as *packed blocks*: a map task groups its rows
by bucket and ships each group as one zstd-compressed Arrow stream, so that a
shuffle of text costs about a third of its size and a handful of rows.  Buckets
come from a hash of the row's content, hence a task that is run again after an
executor was lost makes the same blocks.
"""

from __future__ import annotations

import ctypes
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of stored input that one bucket should hold.
BUCKET_BYTES = 4 << 20
#: Bytes of rows that a map task gathers before it ships its blocks.
FLUSH_BYTES = 16 << 20
#: Bytes of an Arrow batch that Spark hands to Python.
ARROW_BYTES = 8 << 20


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  only GNU's has it
except (OSError, AttributeError):
    _libc = None


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trim() -> None:
    """Give memory that is free back to the system: idle workers keep their processes."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once for each Spark context.

    Batches handed to Python hold whole texts, so the session's limit of their
    bytes is lowered to ``ARROW_BYTES`` where it is higher.
    """
    context = spark.sparkContext
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").strip().lower()
    unit = {"k": 10, "m": 20, "g": 30}.get(most.rstrip("b")[-1:], 0)
    if int(re.match(r"-?\d+", most)[0]) << unit > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(context, "_millrace_shipped", False):
        return
    import io
    import tempfile
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted([top / "__init__.py", *(top / "llm").glob("*.py")]):
            z.write(f, str(f.relative_to(top.parent)))
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace_llm.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._millrace_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's checkpoint folder; set one of this machine only in local mode, where that is shared."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is stored by now.

    It does so when the driver collects its garbage, which may be long after
    several steps have filled the disks.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_count(df: DataFrame, per_bucket: int = BUCKET_BYTES) -> int:
    """How many buckets keep each near ``per_bucket`` bytes of stored input.

    The size is the optimizer's file-size estimate, so nothing is scanned; where
    there is none (rows made in memory), the text itself is summed.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 55:
        lengths = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
        total = sum(lengths[1:], lengths[0]) if lengths else F.lit(64)
        size = int(df.agg(F.sum(F.coalesce(total, F.lit(0)))).first()[0] or 0) // 2
    return max(least, math.ceil(size / per_bucket))


def to_block(table: pa.Table | pa.RecordBatch) -> bytes:
    """An Arrow stream of the rows, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def from_blocks(blobs) -> pa.Table:
    """The rows of several blocks."""
    trim()
    d = zstandard.ZstdDecompressor()
    return pa.concat_tables(pa.ipc.open_stream(d.decompress(b)).read_all() for b in blobs).combine_chunks()


def _pack(batches):
    held, size = [], 0

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        bucket = t.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket, t = bucket[order], t.drop_columns(["bucket"]).take(pa.array(order))
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        blobs = [to_block(t.slice(a, b - a).combine_chunks()) for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= FLUSH_BYTES:
            yield flush()
            held, size = [], 0
            trim()
    if held:
        yield flush()


def pack_rows(df: DataFrame) -> DataFrame:
    """``(bucket int, payload binary)`` blocks of a frame that has a ``bucket`` column."""
    ship(df.sparkSession)
    return df.mapInArrow(_pack, "bucket int, payload binary")


def packed_documents(docs: DataFrame, n: int) -> DataFrame:
    """Blocks of ``(doc_id, text)`` with null texts as empty, dealt by content hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return pack_rows(rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("bucket"), "doc_id", "text"))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as byte-transposed, compressed differences."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The inverse of :func:`pack_sorted`."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8"), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes modulo 2**64 of any byte substrings, from one prefix sum.

    With ``S[i] = sum(T[byte_j] * B**j for j < i)``, the substring ``[i, j)`` has
    ``(S[j] - S[i]) * B**-i``; ``B`` is odd, so its inverse exists.
    """

    _tables: dict = {}

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 8 + 5
        self.seed = seed

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._tables.get(self.seed)
        if have is None or len(have[0]) < n:
            m = -(-n // 65536) * 65536
            up, down = np.empty(m, np.uint64), np.empty(m, np.uint64)
            for out, b in ((up, self.base), (down, pow(self.base, -1, 1 << 64))):
                out[0], k, step = 1, 1, b
                while k < m:
                    out[k : 2 * k] = out[: min(k, m - k)] * np.uint64(step)
                    step, k = step * step % (1 << 64), 2 * k
            have = self._tables[self.seed] = (up, down)
        return have

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of the bytes, one longer than they are."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self._powers(len(data) + 1)[0][: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings ``[start, end)``."""
        return mix64((prefix[end] - prefix[start]) * self._powers(len(prefix))[1][start])


def chunks_by_bytes(sizes, limit: int):
    """Ranges of consecutive rows whose sizes sum to about ``limit``; a larger row stands alone."""
    a = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def _end_keys(batches):
    least = most = None
    for b in batches:
        if b.num_rows:
            first, last = b.column(0)[0].as_py(), b.column(0)[b.num_rows - 1].as_py()
            least = first if least is None else min(least, first)
            most = last if most is None else max(most, last)
    if least is not None:
        yield pa.RecordBatch.from_pydict({"least": [least], "most": [most]})


def key_ranges(keys: DataFrame, n: int) -> tuple[list, list]:
    """The smallest and the largest key of each of about ``n`` ranges of ``keys`` (one column ``key``).

    Two values for each range come to the driver, however many rows there are.
    Each is a key that occurs; equal keys are in one range.
    """
    kind = keys.dtypes[0][1]
    ranged = keys.repartitionByRange(n, "key").sortWithinPartitions("key")
    found = sorted(tuple(r) for r in ranged.mapInArrow(_end_keys, f"least {kind}, most {kind}").collect())
    return [x for x, _ in found], [y for _, y in found]


def squeeze(raw: bytes) -> bytes:
    """Bytes behind one flag byte, compressed where that can pay."""
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 256 else b"\0" + raw


def unsqueeze(blob: bytes) -> bytes:
    """The inverse of :func:`squeeze`."""
    return zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]


def pack_strings(words: list[bytes]) -> bytes:
    """Byte strings as count, lengths and content."""
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return squeeze(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpack_strings(blob: bytes) -> pa.Array:
    """The inverse of :func:`pack_strings`, as an Arrow array."""
    raw = unsqueeze(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(raw, "<u4", n, 4), out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 4 * n :])])


def _deal(starts, ends, neighbours):
    import bisect

    text = bool(starts) and isinstance(starts[0], str)
    low, high = (starts, ends) if text else (np.array(starts), np.array(ends))

    def run(batches):
        for b in batches:
            key = b.column(b.schema.get_field_index("key"))
            if text:
                keys = key.to_pylist()
                at = np.array([max(bisect.bisect_right(starts, k) - 1, 0) for k in keys], np.int64)
                first = np.array([starts[i] == k for i, k in zip(at, keys, strict=True)], bool)
                last = np.array([ends[i] == k for i, k in zip(at, keys, strict=True)], bool)
            else:
                keys = key.to_numpy(zero_copy_only=False)
                at = np.maximum(np.searchsorted(low, keys, side="right") - 1, 0)
                first, last = low[at] == keys, high[at] == keys
            yield with_columns(b, bucket=pa.array(at, pa.int32()), extra=pa.array(np.zeros(len(at), np.int8)))
            for side, mask, step in (("next", first, -1), ("previous", last, 1)):
                if side in neighbours and mask.any():
                    again = b.filter(pa.array(mask))
                    yield with_columns(again, bucket=pa.array((at[mask] + step) % len(starts), pa.int32()), extra=pa.array(np.full(again.num_rows, -step, np.int8)))

    return run


def with_columns(b: pa.RecordBatch, **more) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*b.columns, *more.values()], [*b.schema.names, *more])


def ordered_blocks(rows: DataFrame, n: int, neighbours: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``rows`` (with a ``key``) by key range: bucket k is wholly before k + 1.

    With ``"next"`` among the neighbours, the rows of a bucket's first key also
    go to the bucket before it (the first bucket's to the last), so that every
    row meets its successor in one bucket; with ``"previous"`` those of its last
    key go to the bucket after it.  Column ``extra`` is 0 for a bucket's own
    rows, 1 for those that follow them, -1 for those before them.
    """
    ship(rows.sparkSession)
    deal = _deal(*key_ranges(rows.select("key"), n), neighbours)
    return rows.mapInArrow(lambda batches: _pack(deal(batches)), "bucket int, payload binary").repartition(n, "bucket")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder; what is there goes when the driver ends, or with :func:`remove`."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no frame reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
