"""Removal of repeated substrings by a prefix-bounded difference-cover suffix order.

A full suffix array would order suffixes far beyond what matters: two suffixes
concern each other only if their first ``length`` bytes are equal.  So the
difference-cover scheme is cut off there:

1. *Sample.*  Positions whose residue modulo ``v = q*q + q + 1`` lies in a
   perfect difference set of ``q + 1`` residues.  For any two positions there is
   exactly one shift below ``v`` that takes both to sampled ones (or all do).
2. *Name and sort.*  A sampled suffix is named by its first ``length - v + 1``
   bytes (in place of triples and their recursion: names of a fixed length are
   enough), names are sorted by owners of name ranges, neighbours compared.
3. *Merge the remaining suffixes.*  A suffix that shares ``length`` bytes with
   another one has a sampled position at most ``v - 1`` bytes on whose name is
   repeated.  Only suffixes before such a position go on, sampled or not.
4. *Compare adjacent prefixes.*  Those are sorted by their ``length``-byte
   prefix, and equal neighbours mark their bytes.

Names are 64-bit hashes of the bytes: two different prefixes among ``m`` meet
with odds of about ``m*m / 2**65``.  Exact copies of whole documents are found
first and sort once.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import RollingHash
from millrace.llm.exchange import SENT, answers, bucket_documents, masks, send, stored_blocks

LENGTH = 400
#: Bytes whose prefix sums are held at once.
PART = 1 << 19
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@cache
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """``v`` and the perfect difference set for the largest prime q with v <= 0.8 * length.

    The set is found among the powers of x modulo a cubic over the integers
    modulo q: those without a square term (Singer's construction).
    """
    fit = [q for q in range(2, length) if q * q + q + 1 <= 0.8 * length and all(q % d for d in range(2, q))]
    if not fit:
        return 1, (0,)
    q = fit[-1]
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        x, found = (1, 0, 0), []
        for i in range(v):
            if x[2] == 0:
                found.append(i)
            top = x[2]
            x = ((-c * top) % q, (x[0] - b * top) % q, (x[1] - a * top) % q)
        if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
            return v, tuple(found)
    raise AssertionError("no primitive cubic")


def window_hashes(h: RollingHash, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``data[i : i + length]`` for sorted positions, a part of the data at a time."""
    out = np.empty(len(at), np.uint64)
    for base in range(0, len(data), PART):
        a, z = np.searchsorted(at, [base, base + PART])
        if z > a:
            prefix = h.prefix(data[base : base + PART + length])
            own = at[a:z] - base
            out[a:z] = h.spans(prefix, own, own + length)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of half-open intervals sorted by start; touching ones join."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[new[1:], True]]


class _Bucket:
    """A bucket's documents as one run of bytes, and the keys of each step."""

    def __init__(self, t: pa.Table, length: int):
        docs = bucket_documents(t)
        self.ids, texts = docs.column("doc_id"), [x.encode() for x in docs.column("text").to_pylist()]
        self.length, self.sizes = length, np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.texts, self.hash = texts, RollingHash()
        self.whole = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in texts], np.uint64)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The document of each position."""
        return np.searchsorted(self.ends, at, side="right")

    def whole_keys(self) -> np.ndarray:
        return np.unique(self.whole)

    def settle(self, replies: pa.Table, owners: int) -> None:
        """Which documents have an exact copy, and which are sorted for all their copies."""
        keys, inverse, counts = np.unique(self.whole, return_inverse=True, return_counts=True)
        grade, first = masks(replies, keys, 64, owners)
        order = np.argsort(inverse, kind="stable")
        lead = np.zeros(len(inverse), bool)
        lead[order[np.flatnonzero(np.diff(inverse[order], prepend=-1))]] = True
        self.copied = ((grade > 0) | (counts > 1))[inverse]
        self.stands = first[inverse] & lead

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions of the standing documents, and their names."""
        v, residues = difference_cover(self.length)
        short = self.length - v + 1
        mask = np.zeros(v, bool)
        mask[list(residues)] = True
        at = np.flatnonzero(np.resize(mask, len(self.data)))
        doc = self.of(at)
        at = at[(at + short <= self.ends[doc]) & self.stands[doc] & (self.sizes[doc] >= self.length)]
        return at, window_hashes(self.hash, self.data, at, short)

    def remaining(self, replies: pa.Table, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes before a sampled position of a repeated name, and their prefixes' names."""
        at, names = self.sampled()
        keys, inverse, counts = np.unique(names >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        hit = ((masks(replies, keys, bits, owners)[0] > 0) | (counts > 1))[inverse]
        at = at[hit]
        v, _ = difference_cover(self.length)
        a, z = merged(np.maximum(at - v + 1, self.starts[self.of(at)]), at + 1)
        sizes = z - a
        i = np.repeat(a - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(a) else a
        i = i[i + self.length <= self.ends[self.of(i)]]
        return i, window_hashes(self.hash, self.data, i, self.length)

    def removed(self, replies: pa.Table, at: np.ndarray, names: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """The maximal runs of repeated bytes, as positions in the bucket, documents apart."""
        keys, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
        hit = ((masks(replies, keys, 64, owners)[0] > 0) | (counts > 1))[inverse]
        full = np.flatnonzero(self.copied & (self.sizes >= self.length))
        a = np.concatenate([at[hit], self.starts[full]])
        z = np.concatenate([at[hit] + self.length, self.ends[full]])
        order = np.argsort(a, kind="stable")
        a, z = a[order], z[order]
        # a gap of one between documents keeps their runs apart
        shift = self.of(a)
        a, z = merged(a + shift, z + shift)
        shift = np.searchsorted(self.ends + np.arange(len(self.ends)), a, side="right")
        return a - shift, z - shift


def _replies_of(t: pa.Table, step: int) -> pa.Table:
    return t.filter(pc.equal(t.column("step"), step)) if t.num_rows else t


def _steps(length: int, owners: int, bits: int):
    def copies(key, t):
        return send(key[0].as_py(), _Bucket(t, length).whole_keys(), 64, owners)

    def sample(key, t, replies):
        b = _Bucket(t, length)
        b.settle(_replies_of(replies, 0), owners)
        return send(key[0].as_py(), np.unique(b.sampled()[1] >> np.uint64(64 - bits)), bits, owners)

    def merge(key, t, replies):
        b = _Bucket(t, length)
        b.settle(_replies_of(replies, 0), owners)
        return send(key[0].as_py(), np.unique(b.remaining(_replies_of(replies, 1), bits, owners)[1]), 64, owners)

    def finish(key, t, replies):
        b = _Bucket(t, length)
        b.settle(_replies_of(replies, 0), owners)
        a, z = b.removed(_replies_of(replies, 2), *b.remaining(_replies_of(replies, 1), bits, owners), owners)
        doc = b.of(a)
        cuts = np.searchsorted(doc, np.arange(len(b.texts) + 1))
        gone, spans, kept = [], [], []
        for i, text in enumerate(b.texts):
            own = [(x - b.starts[i], y - b.starts[i]) for x, y in zip(a[cuts[i] : cuts[i + 1]].tolist(), z[cuts[i] : cuts[i + 1]].tolist(), strict=True)]
            left, parts = 0, []
            for x, y in own:
                parts.append(text[left:x])
                left = y
            parts.append(text[left:])
            gone.append(sum(y - x for x, y in own))
            spans.append([{"start": int(x), "end": int(y)} for x, y in own])
            kept.append(b"".join(parts))
        return pa.table({"doc_id": b.ids, "n_bytes": pa.array(b.sizes), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return copies, sample, merge, finish


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs (doc_id, text, ...)``, what is left without repeated bytes.

    A byte goes if it lies in a string of ``length`` UTF-8 bytes that also starts
    anywhere else in the input, the same document included; strings don't cross
    documents.  Null texts are empty and lose nothing; repeated rows are copies
    of each other; an empty table gives no rows; other columns are not read.
    """
    blocks, n = stored_blocks(docs)
    bits = min(64, 36 + max(1, n - 1).bit_length())
    copies, sample, merge, finish = _steps(length, n, bits)
    by = blocks.groupBy("bucket")
    replies = answers(by.applyInArrow(copies, SENT)).withColumn("step", F.lit(0))
    for step, f in ((1, sample), (2, merge)):
        more = answers(by.cogroup(replies.groupBy("bucket")).applyInArrow(f, SENT))
        replies = replies.unionByName(more.withColumn("step", F.lit(step)))
    return by.cogroup(replies.groupBy("bucket")).applyInArrow(finish, OUT)


def op1_query(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of documents."""
    return remove_repeats(docs)
