"""BPE encoding and decoding through a table of distinct words.

Rows are dealt into buckets and split into words; each bucket sends the words it
holds, once each, to the owners of those words; an owner encodes each distinct
word once and sends the ids back; every text's ids are then joined by position,
and decoded by looking each id's piece up.  No word travels more than once
between a bucket and an owner, so a very frequent word makes no hot task.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.common import bucket_count, from_blocks, pack_strings, packed_documents, squeeze, unpack_strings, unsqueeze
from millrace.llm.token_counts import tokenizer
from millrace.llm.word_bpe import Rules, encode_units


def _send_words(path: str, owners: int):
    def run(key, t):
        units = Rules.of(path).units
        found: set[str] = set()
        for text in from_blocks(t.column("payload").to_pylist()).column("text").to_pylist():
            found.update(units(text))
        by: dict[int, list[bytes]] = {}
        for w in found:
            b = w.encode()
            by.setdefault(crc32(b) % owners, []).append(b)
        n = len(by)
        return pa.table({"owner": pa.array(list(by), pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "words": pa.array([pack_strings(w) for w in by.values()], pa.binary())})

    return run


def _encode_words(path: str):
    def run(key, t):
        lists = [unpack_strings(b) for b in t.column("words").to_pylist()]
        words = pc.unique(pa.chunked_array(lists))
        flat, counts = encode_units(path, [w.decode() for w in words.to_pylist()])
        ids = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)]), pa.array(flat))
        out = []
        for own in lists:
            mine = ids.take(pc.index_in(own, value_set=words))
            lengths = np.diff(mine.offsets.to_numpy()).astype("<u4")
            out.append(squeeze(lengths.tobytes() + mine.flatten().to_numpy().astype("<u4").tobytes()))
        return pa.table({"bucket": t.column("bucket").cast(pa.int32()), "words": t.column("words").cast(pa.binary()), "ids": pa.array(out, pa.binary())})

    return run


def _joined(values: pa.Array, offsets: np.ndarray) -> list[str]:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), values), pa.scalar(" ", values.type)).to_pylist()


def _join_ids(path: str, digest: bool, lists: bool):
    def run(key, docs, replies):
        tok, units = tokenizer(path), Rules.of(path).units
        pieces = pa.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())], pa.large_string())
        decimal = pa.array([str(i) for i in range(len(pieces))], pa.large_string())
        as_ids: dict[str, str] = {}
        as_text: dict[str, str] = {}
        counts: dict[str, int] = {}
        for words, blob in zip(replies.column("words").to_pylist(), replies.column("ids").to_pylist(), strict=True):
            words = [w.decode() for w in unpack_strings(words).to_pylist()]
            raw = np.frombuffer(unsqueeze(blob), "<u4")
            lengths, flat = raw[: len(words)].astype(np.int64), pa.array(raw[len(words) :])
            offsets = np.r_[0, np.cumsum(lengths)]
            counts.update(zip(words, lengths.tolist(), strict=True))
            as_ids.update(zip(words, _joined(decimal.take(flat), offsets), strict=True))
            as_text.update(zip(words, _joined(pieces.take(flat), offsets), strict=True))
        t = from_blocks(docs.column("payload").to_pylist())
        n, ids, decoded, numbers = [], [], [], []
        for text in t.column("text").to_pylist():
            # a unit may have no ids at all (a stretch of spaces and marks that vanish)
            found = [u for u in units(text) if counts[u]]
            n.append(sum(map(counts.__getitem__, found)))
            i, d = " ".join(map(as_ids.__getitem__, found)), " ".join(map(as_text.__getitem__, found))
            if lists:
                numbers.append(np.array(i.split(), np.int32))
            if digest or lists:
                i, d = hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()
            ids.append(i)
            decoded.append(d)
        first = pa.array(numbers, pa.list_(pa.int32())) if lists else pa.array(ids, pa.string())
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids": first, "decoded": pa.array(decoded, pa.string())})

    return run


def encode_documents(docs: DataFrame, path: str, digest: bool = False, lists: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for each row of ``docs (doc_id, text, ...)``.

    ``ids`` are decimal and joined by one space; ``decoded`` is what the library
    makes of them, special tokens included; with ``digest`` both are lowercase
    SHA-256; with ``lists`` the ids are integers, and only ``decoded`` is a digest.
    A null text is empty: no tokens, two empty strings.  Repeated rows
    and rows without a doc_id each give a row; an empty table gives none.  Other
    columns are not read.
    """
    n = bucket_count(docs)
    blocks = packed_documents(docs, n).repartition(n, "bucket")
    sent = blocks.groupBy("bucket").applyInArrow(_send_words(path, n), "owner int, bucket int, words binary")
    replies = sent.groupBy("owner").applyInArrow(_encode_words(path), "bucket int, words binary, ids binary")
    return blocks.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_join_ids(path, digest, lists), f"doc_id long, n_tokens long, ids {'array<int>' if lists else 'string'}, decoded string")


def op3_query(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of documents."""
    return encode_documents(docs, path, digest=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
