"""N-gram Jaccard join by prefix filters under several global token orders.

Documents with one shingle set form a class.  Two sets whose Jaccard likeness
reaches the threshold share a token among the first ``size - ceil(t * size) + 1``
of each, whatever order all tokens are put in.  Candidates must do so under a
rare-first order (which makes the posting lists short) and under two hash
orders; those that pass all filters are compared in full.

Links are only needed up to connection.  In each posting list all classes are
first compared with one pivot, the class with the fewest unshared tokens, which
is the source of its copies where that is in the table; only classes that are
still apart are then compared with each other, chunk by chunk.  So a group of
copies of one source costs comparisons in proportion to its size, and no link
between different components is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import RollingHash, checkpoint, chunks_by_bytes, mix64, release
from millrace.llm.exchange import SENT, answers, bucket_documents, masks, send, stored_blocks

SHINGLE = 4
#: The threshold, in hundredths.
PERCENT = 85
#: Seeds of the hash orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PART = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h, out = RollingHash(), np.empty(len(starts), np.uint64)
    for base in range(0, len(data), PART):
        a, z = np.searchsorted(starts, [base, base + PART])
        if z > a:
            prefix = h.prefix(data[base : int(ends[z - 1])])
            out[a:z] = h.spans(prefix, starts[a:z] - base, ends[a:z] - base)
    return out


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of the distinct shingles of each text, sorted."""
    docs, tokens, base = [], [], 0
    weights = [np.uint64(2 * (mix64(np.array([size * 1000 + i], np.uint64))[0] >> np.uint64(1)) + np.uint64(1)) for i in range(size)]
    for a, z in chunks_by_bytes([len(x) + 1 for x in texts], 4 * PART):
        data = np.frombuffer(b" ".join(x.lower() for x in texts[a:z]) + b" ", np.uint8)
        bounds = np.cumsum([len(x) + 1 for x in texts[a:z]])
        gap = np.r_[True, _SPACE[data], True]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.flatnonzero(~gap[:-1] & gap[1:])
        doc = np.searchsorted(bounds, starts, side="right")
        w = _word_hashes(data, starts, ends)
        m = len(w) - size + 1
        if m > 0:
            whole = doc[:m] == doc[size - 1 :]
            t = sum((w[i : i + m][whole] * weights[i] for i in range(1, size)), w[:m][whole] * weights[0])
            docs.append(doc[:m][whole] + a)
            tokens.append(mix64(t))
        counts = np.bincount(doc, minlength=z - a)
        firsts = np.cumsum(counts) - counts
        for d in np.flatnonzero((counts > 0) & (counts < size)):
            own, n = w[firsts[d] : firsts[d] + counts[d]], int(counts[d])
            docs.append(np.array([d + a]))
            tokens.append(mix64(np.array([(sum(int(x) * int(k) for x, k in zip(own, weights, strict=False)) + n * 0x9FB21C651E98DF25) % (1 << 64)], np.uint64)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])]
    return doc[new], token[new]


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """How many first tokens must hold a shared one."""
    return size - -(-percent * size // 100) + 1


def _set_bytes(tokens: np.ndarray) -> bytes:
    """Tokens, sorted."""
    return np.sort(tokens).astype("<u8").tobytes()


def _set_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


ROWS = "doc_id long, set_key binary, n_shingles long, lonely double, tokens array<long>, orders array<array<int>>, content binary"


def _steps(size: int, percent: int, bits: int, owners: int):
    cut = np.uint64(64 - bits)

    def tokens(key, t):
        return send(key[0].as_py(), np.unique(shingles([x.encode() for x in bucket_documents(t).column("text").to_pylist()], size)[1] >> cut), bits, owners)

    def prefixes(key, t, replies):
        docs = bucket_documents(t)
        doc, token = shingles([x.encode() for x in docs.column("text").to_pylist()], size)
        keys, inverse, counts = np.unique(token >> cut, return_inverse=True, return_counts=True)
        grade = masks(replies, keys, bits, owners)[0][inverse]
        shared = (grade > 0) | (counts > 1)[inverse]
        edges = np.searchsorted(doc, np.arange(docs.num_rows + 1))
        out, seen = {k: [] for k in ("set_key", "n_shingles", "lonely", "tokens", "orders", "content")}, set()
        for i in range(docs.num_rows):
            a, z = edges[i], edges[i + 1]
            own, n = token[a:z], int(z - a)
            set_key = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None
            row = (set_key, n, None, None, None, None)
            if n and set_key not in seen and shared[a:z].any():
                seen.add(set_key)
                p = prefix_length(n, percent)
                first = np.lexsort((own, grade[a:z]))[:p]
                held = own[first][shared[a:z][first]]
                if len(held):
                    others = [np.sort(mix64(own ^ np.uint64(seed)))[:p] for seed in ORDERS]
                    row = (set_key, n, float(np.count_nonzero(~shared[a:z]) / n), held.view(np.int64).tolist(), [(o >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() for o in others], _set_bytes(own))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        kinds = (pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.binary())
        return pa.table({"doc_id": docs.column("doc_id"), **{k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}})

    return tokens, prefixes


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = _set_of(x), _set_of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _linked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets are alike enough."""
    light = classes.select("set_key", "n_shingles", "orders")
    left = light.select(F.col("set_key").alias("a"), F.col("n_shingles").alias("na"), F.col("orders").alias("oa"))
    right = light.select(F.col("set_key").alias("b"), F.col("n_shingles").alias("nb"), F.col("orders").alias("ob"))
    near = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    for i in range(len(ORDERS)):
        near = near.where(F.arrays_overlap(F.col("oa")[i], F.col("ob")[i]))
    sets = classes.select("set_key", "content")
    full = near.select("a", "b").join(sets.select(F.col("set_key").alias("a"), F.col("content").alias("ca")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("content").alias("cb")), "b")
    return full.select("a", "b", "ca", "cb").mapInArrow(_verify(percent), "a binary, b binary")


#: Classes of a chunk: a task compares two chunks.
CHUNK = 100


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some lists of distinct values share."""
    n = len(lists)
    owner = np.repeat(np.arange(n), [len(x) for x in lists])
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    many = (counts > 1)[inverse]
    owner, column = owner[many], place[inverse[many]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float64)
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, z = np.searchsorted(column, [base, base + 2048])
        x = np.zeros((n, 2048), np.float32)
        x[owner[a:z], column[a:z] - base] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _compare(percent: int):
    def run(key, t):
        keys, roots = t.column("set_key").to_pylist(), t.column("root").to_pylist()
        sets = [_set_of(x) for x in t.column("content").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        group = np.array([names[r] for r in roots])
        maybe = np.triu(group[:, None] != group[None, :])
        maybe &= np.minimum.outer(sizes, sizes) * 100 >= np.maximum.outer(sizes, sizes) * percent
        for orders in zip(*t.column("orders").to_pylist(), strict=True):
            maybe &= overlaps([np.unique(np.array(x, np.int32)) for x in orders]) > 0
        pairs: list[tuple[bytes, bytes]] = []
        if maybe.any():
            both = overlaps(sets)
            above = {i: i for i in names.values()}

            def top(i):
                while above[i] != i:
                    i = above[i]
                return i

            for i, j in np.argwhere(maybe & (100 * both >= percent * (np.add.outer(sizes, sizes) - both))).tolist():
                x, y = top(group[i]), top(group[j])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    pairs.append((keys[i], keys[j]))
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return run


def _linked_apart(open_: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes of different roots that share a posting list.

    ``open_`` has the postings ``(token, set_key, root, a)`` of tokens whose
    classes are not all connected, with each token's least class.  Connected by
    such tokens, the classes fall into groups; a group is cut into chunks of
    about ``CHUNK``, of one root where that has so many, else of mixed ones, and
    a task compares two chunks, unless both are of one root.
    """
    release(open_.sparkSession)
    groups = components(open_.where("set_key != a").select("a", F.col("set_key").alias("b")))
    nodes = open_.select("set_key", "root").distinct().join(groups.select(F.col("node").alias("set_key"), F.col("root").alias("top")), "set_key", "left").select("set_key", "root", F.coalesce("top", "set_key").alias("top"))
    nodes = checkpoint(nodes)
    sizes = nodes.groupBy("top", "root").count()
    kinds = sizes.select("top", "root", F.when(F.col("count") > CHUNK, F.hex("root")).otherwise(F.lit("")).alias("kind"), "count")
    counts = kinds.groupBy("top", "kind").agg(F.ceil(F.sum("count") / CHUNK).alias("parts"))
    dealt = nodes.join(kinds.drop("count"), ["top", "root"]).join(counts, ["top", "kind"])
    release(open_.sparkSession)
    dealt = checkpoint(dealt.select("set_key", "root", "top", "kind", F.concat_ws(":", "kind", F.pmod(F.xxhash64("set_key"), "parts").cast("string")).alias("chunk")))
    chunks = counts.select("top", "kind", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.concat_ws(":", "kind", k.cast("string")))).alias("other"))
    chunks = chunks.groupBy("top").agg(F.collect_list(F.struct("kind", "other")).alias("others"))
    jobs = dealt.join(chunks, "top").select("set_key", "root", "top", "kind", "chunk", F.explode("others").alias("o")).where("kind != o.kind or kind = ''")
    jobs = jobs.select("set_key", "root", F.concat_ws("/", F.hex("top"), F.least("chunk", "o.other"), F.greatest("chunk", "o.other")).alias("job"))
    return jobs.join(classes.select("set_key", "orders", "content"), "set_key").groupBy("job").applyInArrow(_compare(percent), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of undirected edges ``(a, b)``: the least node connected.

    Alternates the large-star and the small-star step, both of which keep the
    connections, until nothing changes; each round is stored.
    """
    edges, before = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs (doc_id, text, ...)``.

    A document's tokens are its distinct ``size``-word shingles (the whole
    sequence where it has fewer words), over words between ASCII white space
    with A-Z lower-cased.  Documents link where ``100 * shared >= percent *
    union``; ``component_id`` is the least doc_id reachable.  Null texts, and
    texts without words, have no tokens and stay alone.  Repeated rows are
    copies; rows without a doc_id take part, and name a component only where all
    its doc_ids are null (then null).  An empty table gives no rows; other
    columns are not read.  Tokens are 64-bit hashes.
    """
    blocks, n = stored_blocks(docs)
    bits = min(64, 32 + max(1, n - 1).bit_length())
    tokens, prefixes = _steps(size, percent, bits, n)
    by = blocks.groupBy("bucket")
    replies = answers(by.applyInArrow(tokens, SENT))
    release(docs.sparkSession)
    rows = checkpoint(by.cogroup(replies.groupBy("bucket")).applyInArrow(prefixes, ROWS))
    release(docs.sparkSession)
    classes = checkpoint(rows.where("content is not null").groupBy("set_key").agg(*(F.first(c).alias(c) for c in ("n_shingles", "lonely", "tokens", "orders", "content"))))
    postings = classes.select("set_key", "lonely", F.explode("tokens").alias("token"))
    # stored before they are joined: a join of two plain exchanges is split where a token is hot
    heads = checkpoint(postings.groupBy("token").agg(F.min(F.struct("lonely", "set_key")).alias("head"), F.count("*").alias("n")).where("n > 1").select("token", F.col("head.set_key").alias("pivot")))
    held = checkpoint(postings.join(heads, "token").select("token", "set_key", "pivot"))
    star = checkpoint(held.where("set_key != pivot").select(F.least("set_key", "pivot").alias("a"), F.greatest("set_key", "pivot").alias("b")).distinct())
    links = checkpoint(_linked(star, classes, percent))
    joined = held.select("token", "set_key").join(components(links).withColumnRenamed("node", "set_key"), "set_key", "left").select("token", "set_key", F.coalesce("root", "set_key").alias("root"))
    apart = checkpoint(joined.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("set_key").alias("a")).where("x != y").select("token", "a"))
    open_ = checkpoint(joined.join(apart, "token"))
    roots = components(links.unionByName(checkpoint(_linked_apart(open_, classes, percent))))

    members = rows.select("doc_id", "set_key", "n_shingles")
    least = members.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rooted = checkpoint(least.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_key", "component_id")
    return members.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_query(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of documents."""
    return near_duplicates(docs)
