"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so token labels are made first: a word of a toxic
training document counts as toxic if it, or one of its beginnings, is found in
toxic training documents much more often than in others.  A two-state chain
(plain, toxic) with word and word-beginning features is fitted to windows of
those tokens.  Scoring runs forward-backward over whole documents; runs of
words without any feature all have the same factor, whose power has a closed
form, so their length costs nothing.  The marginals are aggregated to a document
score by a logistic layer, and toxic words are given as character offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import RollingHash, chunks_by_bytes, mix64, ship, trim

#: Bounds of the labelled sample that the model is fitted on.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 16 << 20
#: The largest text of the sample is one so many-th of its bytes.
SHARE = 64
#: Words with a feature, for each text of the sample on average, around which the chain learns, and its windows in all.
CENTRES, WINDOWS = 8, 8000
#: Features kept at most, and the documents and the lift that one needs.
FEATURES, LEAST_DOCS, LIFT = 4000, 5, 4.0
#: Byte lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words on either side of a training window's centre.
REACH = 6
PART = 1 << 19
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """The words of some texts: document, byte bounds within the part, feature hashes (0: none)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    marks: np.ndarray  # words x (1 + beginnings)
    offset: np.ndarray  # of each document in the part


def words_of(texts: list[bytes]) -> Words:
    """Words (ASCII letters and digits, and all other bytes from 0x80) with A-Z lower-cased."""
    data = np.frombuffer(b" ".join(x.lower() for x in texts) + b" ", np.uint8)
    bounds = np.cumsum([len(x) + 1 for x in texts])
    inside = np.r_[False, _WORD[data]]
    start = np.flatnonzero(~inside[:-1] & inside[1:])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    h = RollingHash()
    marks = np.zeros((len(start), 1 + len(BEGINNINGS)), np.uint64)
    for base in range(0, len(data), PART):
        a, z = np.searchsorted(start, [base, base + PART])
        if a == z:
            continue
        prefix = h.prefix(data[base : int(end[z - 1])])
        s, e = start[a:z] - base, end[a:z] - base
        marks[a:z, 0] = h.spans(prefix, s, e)
        for k, n in enumerate(BEGINNINGS, 1):
            longer = np.flatnonzero(e - s > n)
            marks[a + longer, k] = mix64(h.spans(prefix, s[longer], s[longer] + n) + np.uint64(n))
    return Words(np.searchsorted(bounds, start, side="right"), start, end, marks, np.r_[0, bounds[:-1]])


@dataclass
class Model:
    """A fitted chain: sorted feature hashes with weights, transitions, and the document layer."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # log factors, from state to state
    layer: np.ndarray

    def scores(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that have a feature, and their log factor for the toxic state."""
        if not len(self.keys) or not len(marks):
            return np.zeros(0, np.int64), np.zeros(0)
        table = np.zeros(1 << 16, bool)
        table[self.keys & np.uint64(0xFFFF)] = True
        hit = np.flatnonzero(table[marks & np.uint64(0xFFFF)].any(axis=1))
        near = marks[hit]
        at = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
        w = np.where(self.keys[at] == near, self.weights[at], 0.0)
        some = (self.keys[at] == near).any(axis=1)
        return hit[some], w.sum(axis=1)[some] + self.bias

    def marginals(self, gaps: list[int], factors: list[float]) -> list[float]:
        """The toxic marginals of the words with features; ``gaps`` of plain words lie before each and after the last."""
        t = np.exp(self.trans)
        (a, b), (c, d) = (t * np.array([1.0, math.exp(self.bias)])).tolist()
        mean, det = (a + d) / 2, a * d - b * c
        root = math.sqrt(max(mean * mean - det, 1e-18))
        high, ratio = mean + root, (mean - root) / (mean + root)
        low = mean - root
        # M**g / high**g = P + ratio**g * Q
        p = [(a - low) / (high - low), b / (high - low), c / (high - low), (d - low) / (high - low)]
        q = [1 - p[0], -p[1], -p[2], 1 - p[3]]
        (ta, tb), (tc, td) = t.tolist()

        def power(g: int) -> tuple[float, float, float, float]:
            r = ratio**g
            return p[0] + r * q[0], p[1] + r * q[1], p[2] + r * q[2], p[3] + r * q[3]

        ahead, x, y = [], 1.0, 0.0
        for g, f in zip(gaps, factors, strict=False):
            if g:
                m = power(g)
                x, y = x * m[0] + y * m[2], x * m[1] + y * m[3]
            x, y = x * ta + y * tc, (x * tb + y * td) * math.exp(min(f, 50.0))
            s = x + y
            x, y = x / s, y / s
            ahead.append((x, y))
        out, x, y = [0.0] * len(factors), 1.0, 1.0
        for i in range(len(factors) - 1, -1, -1):
            if gaps[i + 1]:
                m = power(gaps[i + 1])
                x, y = m[0] * x + m[1] * y, m[2] * x + m[3] * y
            u, v = ahead[i]
            out[i] = v * y / (u * x + v * y)
            e = math.exp(min(factors[i], 50.0))
            x, y = ta * x + tb * e * y, tc * x + td * e * y
            s = x + y
            x, y = x / s, y / s
        return out

    def documents(self, texts: list[bytes]) -> list[tuple[list[float], list[tuple[int, int]], int]]:
        """For each text: marginals and byte bounds of its words with features, and its number of words."""
        out: list = []
        for a, z in chunks_by_bytes([len(x) + 1 for x in texts], 2 * PART):
            w = words_of(texts[a:z])
            hit, factor = self.scores(w.marks)
            total = np.bincount(w.doc, minlength=z - a)
            first = np.cumsum(total) - total
            cuts = np.searchsorted(w.doc[hit], np.arange(z - a + 1))
            for i in range(z - a):
                own = hit[cuts[i] : cuts[i + 1]]
                at = (own - first[i]).tolist()
                gaps = [y - x - 1 for x, y in zip([-1, *at], [*at, int(total[i])], strict=True)]
                p = self.marginals(gaps, factor[cuts[i] : cuts[i + 1]].tolist()) if at else []
                bounds = list(zip((w.start[own] - w.offset[i]).tolist(), (w.end[own] - w.offset[i]).tolist(), strict=True))
                out.append((p, bounds, int(total[i])))
        return out

    def score(self, p: list[float], n: int) -> float:
        """The document score from its marginals and its number of words."""
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(_aggregate(p, n) @ self.layer)))))


def _aggregate(p: list[float], n: int) -> np.ndarray:
    total = sum(p)
    return np.array([1.0, math.log1p(total), math.log1p(1000 * total / (n + 20)) / 3, max(p, default=0.0)])


def _fit_layer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (s - y) + 0.05 * w)
    return w


def _fit_chain(ids: np.ndarray, labels: np.ndarray, n: int, rounds: int = 150) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the likelihood of windows: ``ids`` windows x words x marks (n: no feature)."""
    size, length, _ = ids.shape
    theta, lam = np.zeros(n + 1 + 1 + 4), 1e-3
    theta[n + 1] = -1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, bias, trans = np.r_[theta[:n], 0.0], theta[n + 1], theta[n + 2 :].reshape(2, 2)
        e = np.stack([np.zeros((size, length)), w[ids].sum(axis=2) + bias], axis=2)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        prev = np.tile([0.0, -1e9], (size, 1))
        for t in range(length):
            fwd[:, t] = e[:, t] + np.logaddexp(prev[:, 0, None] + trans[0], prev[:, 1, None] + trans[1])
            prev = fwd[:, t]
        z = np.logaddexp(prev[:, 0], prev[:, 1])
        for t in range(length - 2, -1, -1):
            nxt = e[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
        g = np.zeros_like(theta)
        off = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) - labels
        np.add.at(g[: n + 1], ids.reshape(-1), np.repeat(off.reshape(-1), ids.shape[2]))
        g[n], g[n + 1] = 0.0, off.sum()
        pair = fwd[:, :-1, :, None] + trans + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
        expected = np.exp(pair).sum(axis=(0, 1))
        first = np.exp(trans[0] + (e + bwd)[:, 0] - z[:, None]).sum(axis=0)
        expected[0] += first
        before = np.c_[np.zeros(size, np.int64), labels[:, :-1]]
        seen = np.zeros((2, 2))
        np.add.at(seen, (before.reshape(-1), labels.reshape(-1)), 1.0)
        g[n + 2 :] = (expected - seen).reshape(-1)
        g = g / size + lam * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n + 1]), theta[n + 2 :].reshape(2, 2)


def _document_counts(texts: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and the number of texts that have each; of those ``among`` alone, zeros included."""
    keys, counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if among is None else (among, np.zeros(len(among), np.int64))
    for a, z in chunks_by_bytes([len(x) + 1 for x in texts], 2 * PART):
        w = words_of(texts[a:z])
        doc, mark = np.repeat(w.doc, w.marks.shape[1]), w.marks.reshape(-1)
        keep = mark != 0 if among is None else np.isin(mark, among)
        doc, mark = doc[keep], mark[keep]
        order = np.lexsort((mark, doc))
        doc, mark = doc[order], mark[order]
        once = mark[np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]] if len(mark) else mark
        k, c = np.unique(once, return_counts=True)
        if among is not None:
            counts[np.searchsorted(keys, k)] += c
            continue
        both, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, c]), len(both)).astype(np.int64)
        keys = both
    return keys, counts


def fit(texts: list[bytes], toxic: np.ndarray, centres: int = CENTRES, windows: int = WINDOWS) -> Model:
    """The model of labelled texts; without both kinds of label, the constant base rate.

    The chain learns from windows of words around at most ``centres`` words with
    a feature for each text on average, and some without, and from ``windows``
    of them at most; a window that reaches beyond its text is filled up with
    words without features.
    """
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros((2, 2)), np.array([math.log(rate / (1 - rate)) if len(toxic) else -5.0, 0, 0, 0]))
    if not len(toxic) or toxic.min() == toxic.max():
        return empty
    k1, c1 = _document_counts([t for t, y in zip(texts, toxic, strict=True) if y == 1])
    k1, c1 = k1[c1 >= LEAST_DOCS], c1[c1 >= LEAST_DOCS]
    _, other = _document_counts([t for t, y in zip(texts, toxic, strict=True) if y == 0], k1)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    lift = (c1 / n1) / ((other + 0.5) / n0)
    gain = c1 * np.log(np.maximum(lift, 1e-9))
    best = np.flatnonzero(lift >= LIFT)
    best = best[np.argsort(-gain[best], kind="stable")][:FEATURES]
    best = best[np.argsort(k1[best])]
    keys, strong = k1[best], (c1 / (c1 + other + 1.0))[best] >= 0.5
    if not len(keys):
        return empty

    ids, labels = [], []
    rng = np.random.default_rng(7)
    for a, z in chunks_by_bytes([len(x) + 1 for x in texts], 2 * PART):
        w = words_of(texts[a:z])
        at = np.minimum(np.searchsorted(keys, w.marks), len(keys) - 1)
        ids_all = np.where(keys[at] == w.marks, at, len(keys))
        label = (np.where(ids_all < len(keys), strong[np.minimum(ids_all, len(keys) - 1)], False).any(axis=1) & (toxic[a + w.doc] == 1)).astype(np.int64)
        some = np.flatnonzero((ids_all < len(keys)).any(axis=1))
        plain = rng.integers(0, len(w.doc), min(len(w.doc), (z - a) // 4 + 1)) if len(w.doc) else some[:0]
        middle = np.unique(np.r_[rng.choice(some, min(len(some), centres * (z - a)), replace=False), plain])
        span = middle[:, None] + np.arange(-REACH, REACH + 1)
        there = np.clip(span, 0, max(len(w.doc) - 1, 0))
        own = (span == there) & (w.doc[there] == w.doc[middle][:, None]) if len(middle) else np.zeros(span.shape, bool)
        ids.append(np.where(own[:, :, None], ids_all[there], len(keys)) if len(middle) else ids_all[there])
        labels.append(np.where(own, label[there], 0) if len(middle) else label[there])
    ids, labels = np.concatenate(ids), np.concatenate(labels)
    if len(ids) > windows:
        pick = rng.choice(len(ids), windows, replace=False)
        ids, labels = ids[pick], labels[pick]
    if not len(ids):
        return empty
    weights, bias, trans = _fit_chain(ids, labels, len(keys))
    model = Model(keys, weights, bias, trans, np.zeros(4))
    model.layer = _fit_layer(np.array([_aggregate(p, n) for p, _, n in model.documents(texts)]), toxic.astype(float))
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning; a row without a doc_id never learns nor is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, share: int = SHARE, centres: int = CENTRES, windows: int = WINDOWS) -> Model:
    """Fit on a bounded sample of the labelled rows that may be learnt from.

    The sample are the rows with the least hashes of their doc_ids: at most
    ``rows``, and no more than fit in ``most_bytes`` of text; a text over one
    ``share``-th of that is left out, so that no few texts fill the sample, and
    where one doesn't fit any more, shorter ones after it may.  ``centres`` and
    ``windows`` bound what the chain is fitted on (see :func:`fit`).  Of
    repeated doc_ids the greatest text counts, of repeated labels the greatest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows).collect()
    spark = docs.sparkSession
    rank = {r[0]: i for i, r in enumerate(picked)}
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])

    def of(keys):
        chosen = spark.createDataFrame([(r[0], r[1]) for r in picked if r[0] in keys], schema)  # at most `rows` rows
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    sizes: dict[int, int] = {}
    for k, n in of(rank).groupBy("doc_id").agg(F.max(F.octet_length("text"))).collect():
        sizes[k] = n
    keep, total = set(), 0
    for k in sorted(sizes, key=rank.__getitem__):
        if total + sizes[k] > most_bytes or sizes[k] * share > most_bytes:
            continue
        keep.add(k)
        total += sizes[k]
    found = sorted(of(keep).groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).collect(), key=lambda r: r[0]) if keep else []
    return fit([r[2].encode() for r in found], np.array([r[1] for r in found], np.int64), centres, windows)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def score(df: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """The frame with ``score`` (0 to 1) and, with ``spans``, the offending words.

    ``spans`` are code-point offsets of words whose toxic marginal is 0.5 or
    more.  A null or empty text gets the score of a text without evidence.
    Repeated rows get equal results; an empty table stays empty; existing
    columns of the added names are replaced.
    """
    ship(df.sparkSession)
    df = df.drop("score", *["spans"] * spans)
    fields = [*df.schema.fields, T.StructField("score", T.DoubleType())] + ([T.StructField("spans", SPANS)] if spans else [])

    def run(batches):
        for b in batches:
            texts = [(x or "").encode() for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            found = model.documents(texts)
            more = [pa.array([model.score(p, n) for p, _, n in found], pa.float64())]
            if spans:
                rows = []
                for text, (p, bounds, _) in zip(texts, found, strict=True):
                    bad = [(x, y, q) for (x, y), q in zip(bounds, p, strict=True) if q >= 0.5]
                    points = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)] if bad else []
                    rows.append([{"start": int(points[x]), "end": int(points[y]), "p": q} for x, y, q in bad])
                more.append(pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            trim()
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "score", "spans"][: len(b.columns) + len(more)])

    return df.mapInArrow(run, T.StructType(fields))


def op7_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of documents."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, model, spans=False).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
