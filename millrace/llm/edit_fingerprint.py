"""Document fingerprints by a randomised edit embedding.

Every text is walked by the same random walk: at step ``j`` the character under
the cursor is put out, and the cursor moves on or stays as a coin decides that
depends on ``j`` and the character alone.  Two walks that have drifted apart by
an edit soon meet again, so edit distance becomes Hamming distance between the
outputs.  The fingerprint samples the output at fixed steps, as many in each
octave of steps, four bits a sample (of the last four characters put out; zero
once the walk is over).  It so grows with the logarithm of the text's length,
and texts of any two lengths are comparable.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bucket_count, checkpoint, chunks_by_bytes, from_blocks, mix64, ordered_blocks, ship
from millrace.llm.ngram_join import components

#: Samples of an octave; the first octave is the first steps themselves.
SAMPLES = 32
SEED = 20240607
#: Steps after which the coins repeat.
PERIOD = 4093
#: Characters that a sample hashes.
RUN = 4
#: Walks from which on a step is done for all of them at once.
TOGETHER = 24
NO_ID = -(1 << 63)


@cache
def _coins() -> np.ndarray:
    coins = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    coins[:, 0] = 0  # the end mark: the cursor stays
    return coins


@cache
def sample_steps(octaves: int) -> np.ndarray:
    """The sampled steps, ascending, ``SAMPLES`` for each octave."""
    rng = np.random.default_rng(SEED + 1)
    out = [np.arange(SAMPLES)]
    for o in range(1, octaves):
        low = SAMPLES << (o - 1)
        out.append(np.sort(low + rng.choice(low, SAMPLES, replace=False)))
    return np.concatenate(out)


def _symbols(text: str) -> bytes:
    """A byte from 1 to 255 for each code point, and an end mark."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return (mix64(points + np.uint64(SEED)) % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes() + b"\0"


def _hashed(run: np.ndarray) -> np.ndarray:
    """Four bits, 1 to 15, for each row of the last characters; 0 where the walk is over."""
    h = mix64(run.astype(np.uint64) @ (np.uint64(256) ** np.arange(RUN, dtype=np.uint64)) + np.uint64(SEED))
    return np.where(run[:, -1] == 0, 0, h % np.uint64(15) + np.uint64(1)).astype(np.uint8)


def embed(texts: list[str]) -> list[np.ndarray]:
    """The samples of each text's walk, whole octaves, without those wholly after its end."""
    marks = [_symbols(t) for t in texts]
    sizes = np.array([len(m) - 1 for m in marks], np.int64)
    order = np.argsort(-sizes, kind="stable")
    whole = b"".join(marks[i] for i in order)
    data = np.frombuffer(whole, np.uint8)
    lengths = sizes[order]
    start = np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(order) else np.zeros(0, np.int64)
    end, at = start + lengths, start.copy()
    octaves = 2 + max(1, int(4 * (lengths[0] if len(order) else 0) // SAMPLES + 1).bit_length())
    steps = sample_steps(octaves)
    out = np.zeros((len(order), len(steps)), np.uint8)
    coins = _coins()
    rows = [r.tobytes() for r in coins]
    last = np.zeros((len(order), RUN), np.uint8)
    keep = np.zeros(int(steps[-1]) + 1, bool)
    for r in range(RUN):
        keep[np.maximum(steps - r, 0)] = True
    sampled = {int(s): k for k, s in enumerate(steps)}
    live, j = int(np.count_nonzero(lengths > 0)), 0
    own = np.arange(live)
    at, end = at[:live], end[:live]
    while len(own) >= TOGETHER:
        c = data[at]
        if keep[j]:
            last[own] = np.c_[last[own][:, 1:], c]
            if j in sampled:
                out[own, sampled[j]] = _hashed(last[own])
        at = at + coins[j % PERIOD][c]
        j += 1
        if j % 64 == 0:
            on = at < end
            if not on.all():
                own, at, end = own[on], at[on], end[on]
    kept = np.flatnonzero(keep).tolist()
    import bisect

    first = bisect.bisect_left(kept, j)
    for d, p, e in zip(own.tolist(), at.tolist(), end.tolist(), strict=True):
        i, run = j, last[d].copy()
        for stop in kept[first:]:
            while i < stop and p < e:
                p += rows[i % PERIOD][whole[p]]
                i += 1
            if p >= e:
                break
            run[:-1] = run[1:]
            run[-1] = whole[p]
            if stop in sampled:
                out[d, sampled[stop]] = _hashed(run[None, :])[0]
            p += rows[i % PERIOD][whole[p]]
            i += 1
    result: list[np.ndarray] = [out[:0, 0]] * len(texts)
    for d, i in enumerate(order.tolist()):
        used = np.flatnonzero(out[d])
        result[i] = out[d, : (used[-1] // SAMPLES + 1) * SAMPLES] if len(used) else out[d, :0]
    return result


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Agreement of two samples, octaves weighted by their steps, chance taken off: 0 to 1."""
    n = max(len(x), len(y))
    if not n:
        return 1.0
    if len(x) == len(y) and (x == y).all():
        return 1.0
    a, b = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    a[: len(x)], b[: len(y)] = x, y
    octave = np.arange(n) // SAMPLES
    weight = np.where(octave < 1, 1.0, 2.0 ** (octave - 1)) * ((a | b) > 0)
    same = float((weight * (a == b)).sum() / weight.sum())
    return max(0.0, (same - 1 / 15) / (14 / 15))


def as_text(x: np.ndarray) -> str:
    """Samples as hexadecimal digits."""
    return x.tobytes().hex()[1::2]


def from_text(s: str) -> np.ndarray:
    """The inverse of :func:`as_text`."""
    return np.array([int(c, 16) for c in s], np.uint8)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(key, t):
    rows = from_blocks(t.column("payload").to_pylist()).sort_by([("extra", "ascending"), ("key", "ascending"), ("text", "ascending")])
    n = sum(not x for x in rows.column("extra").to_pylist())
    texts, keys = rows.column("text").to_pylist()[: n + 1], rows.column("key").to_pylist()[:n]
    out = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    following = None
    for a, z in reversed(list(chunks_by_bytes([len(x) for x in texts[:n]], 8 << 20))):
        own = texts[a:z]
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(own, texts[a + 1 : z + 1], strict=True)]
        tail = [] if following is not None else texts[n:]
        prints = embed(own + edited + tail)
        mine, theirs = prints[: len(own)], prints[len(own) : 2 * len(own)]
        after = [*mine[1:], following if following is not None else prints[-1]]
        following = mine[0]
        part = {
            "n_chars": [len(x) for x in own],
            "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
            "fingerprint": [as_text(x) for x in mine],
            "edited_fingerprint": [as_text(x) for x in theirs],
            "near_edited": [likeness(x, y) for x, y in zip(mine, theirs, strict=True)],
            "near_next": [likeness(x, y) for x, y in zip(mine, after, strict=True)],
        }
        for k, v in part.items():
            out[k] = v + out[k]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.table({"doc_id": pa.array([None if k == NO_ID else k for k in keys], pa.int64()), **{k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}})


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each row of ``docs (doc_id, text, ...)`` and compare it with the next.

    See the query's contract for the edited text.  Rows follow each other by
    doc_id, repeated doc_ids by text, rows without one first; the last is
    followed by the first, and a lone row by itself.  Null texts are empty: their
    fingerprint is empty, equal (1.0) to an empty one and unlike (0.0) all else.
    An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return ordered_blocks(rows, bucket_count(docs, 8 << 20), neighbours=("next",)).groupBy("bucket").applyInArrow(_with_next, OUT)


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The frame with a fingerprint of its text column (null: of the empty text); a column ``out`` is replaced."""
    ship(df.sparkSession)
    df = df.drop(out) if out in df.columns and out != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            got = [as_text(x) for a, z in chunks_by_bytes([len(x) for x in texts], 8 << 20) for x in embed(texts[a:z])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


#: Samples of a band and bands of an octave.
BAND, BANDS = 8, 12


#: Fingerprints of a chunk: a task compares two chunks.
CHUNK = 100


def _compare(least: float):
    def run(key, t):
        texts, roots = t.column("fingerprint").to_pylist(), t.column("root").to_pylist()
        above = {r: r for r in roots}

        def top(r):
            while above[r] != r:
                r = above[r]
            return r

        found = []
        prints = [from_text(x) for x in texts]
        for i, x in enumerate(prints):
            for j in range(i):
                p, q = top(roots[i]), top(roots[j])
                if p != q and (near := likeness(x, prints[j])) >= least:
                    above[max(p, q)] = min(p, q)
                    found.append((min(texts[i], texts[j]), max(texts[i], texts[j]), near))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({k: pa.array(v, kind) for k, v, kind in zip("a b near".split(), columns, (pa.string(), pa.string(), pa.float64()), strict=True)})

    return run


def _linked_apart(keyed: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Links between members of a band that ``links`` leave apart.

    Of bands with the same members one is taken.  It is cut into chunks, of one
    root where that has more than ``CHUNK``, else of mixed ones, and a task
    compares two chunks, unless both are of one root.
    """
    roots = components(links).select(F.col("node").alias("fingerprint"), "root")
    joined = checkpoint(keyed.join(roots, "fingerprint", "left").select("band", "fingerprint", F.coalesce("root", "fingerprint").alias("root")))
    members = [F.count("*"), F.min("fingerprint"), F.max("fingerprint"), *(F.sum(F.xxhash64(F.lit(i), "fingerprint").cast("decimal(38,0)")) for i in range(2))]
    same = [f"m{i}" for i in range(len(members))]
    apart = joined.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), *(m.alias(n) for m, n in zip(members, same, strict=True))).where("x != y")
    open_ = checkpoint(joined.join(apart.groupBy(*same).agg(F.min("band").alias("band")).select("band"), "band"))
    sizes = open_.groupBy("band", "root").count()
    kinds = checkpoint(sizes.select("band", "root", F.when(F.col("count") > CHUNK, F.col("root")).otherwise(F.lit("")).alias("kind"), "count"))
    counts = checkpoint(kinds.groupBy("band", "kind").agg(F.ceil(F.sum("count") / CHUNK).alias("parts")))
    dealt = open_.join(kinds.drop("count"), ["band", "root"]).join(counts, ["band", "kind"])
    dealt = dealt.select("fingerprint", "root", "band", "kind", F.concat_ws(":", "kind", F.pmod(F.xxhash64("fingerprint"), "parts").cast("string")).alias("chunk"))
    chunks = counts.select("band", "kind", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.concat_ws(":", "kind", k.cast("string")))).alias("other"))
    chunks = chunks.groupBy("band").agg(F.collect_list(F.struct("kind", "other")).alias("others"))
    jobs = dealt.join(chunks, "band").select("fingerprint", "root", "band", "kind", "chunk", F.explode("others").alias("o")).where("kind != o.kind or kind = ''")
    jobs = jobs.select("fingerprint", "root", F.concat_ws("|", "band", F.least("chunk", "o.other"), F.greatest("chunk", "o.other")).alias("job"))
    return jobs.groupBy("job").applyInArrow(_compare(least), "a string, b string, near double").distinct()


def near_texts(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Verified links ``(a, b, near)``, a < b, between different fingerprints of ``prints (fingerprint)``.

    Fingerprints meet in a band if they agree on its randomly chosen samples of
    one octave.  In each band all are first compared with its least fingerprint,
    then those still apart with each other, chunk by chunk.  The links so
    connect all that any links between members of a band connect (see
    ``near_classes``); further links within a class are not listed.  Equal
    fingerprints count once.
    """
    rng = np.random.default_rng(SEED + 2)
    picks = [sorted(rng.choice(SAMPLES, BAND, replace=False).tolist()) for _ in range(BANDS)]
    distinct = prints.select("fingerprint").where("fingerprint != ''").distinct()
    # an octave that the walk fills is whole; the last may end early, as those of near texts do
    octave = F.explode(F.sequence(F.greatest(F.floor(F.length("fingerprint") / SAMPLES) - 2, F.lit(0)), F.floor(F.length("fingerprint") / SAMPLES) - 1)).alias("octave")
    cut = distinct.select("fingerprint", octave)
    bands = F.array(*(F.concat(F.lit(f"{i}:"), *(F.substring("fingerprint", (F.col("octave") * SAMPLES + p + 1).cast("int"), F.lit(1)) for p in own)) for i, own in enumerate(picks)))
    keyed = cut.select("fingerprint", "octave", F.explode(bands).alias("band")).select("fingerprint", F.concat_ws("/", F.col("octave").cast("string"), "band").alias("band"))
    keyed = checkpoint(keyed)
    heads = keyed.groupBy("band").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    held = checkpoint(keyed.join(heads, "band"))
    pairs = held.where("fingerprint != a").select("a", F.col("fingerprint").alias("b")).distinct()

    def verify(batches):
        for b in batches:
            near = [likeness(from_text(x), from_text(y)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            made = pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.float64())], ["a", "b", "near"])
            yield made.filter(pa.array([x >= least for x in near], pa.bool_()))

    star = checkpoint(pairs.mapInArrow(verify, "a string, b string, near double"))
    return star.unionByName(_linked_apart(held.select("band", "fingerprint"), star, least))


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """``(fingerprint, root)`` of each different fingerprint of ``prints``: the least one connected, itself where there is none."""
    roots = components(near_texts(prints, least)).withColumnRenamed("node", "fingerprint")
    return prints.select("fingerprint").where("fingerprint != ''").distinct().join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def op2_query(docs: DataFrame) -> DataFrame:
    """The fingerprints of documents and of their edited texts."""
    return fingerprints_with_next(docs)
