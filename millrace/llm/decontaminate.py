"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of ``window`` words is represented by the smallest hash of its
k-grams.  Equal windows have equal k-grams, so they have the same smallest hash:
joining the fingerprints of documents and benchmark loses no shared window.  A
fingerprint travels with the stretch of windows that it stands for; where it is
joined, those are compared word for word, so a chance hash makes no hit.  Items shorter than a
window are looked up by the hash of their whole word sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint

WINDOW = 10
K = 4
#: Bytes of a joined side up to which it is broadcast; they are summed first, and
#: a larger one is joined by a shuffle, in which Spark splits the parts of hot keys.
BROADCAST_BYTES = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that are not part of a word, once A-Z is lower-cased.
_BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null: none."""
    flat = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(flat, " "), "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _grams(w: Column, k: int) -> Column:
    """The hash of each k consecutive words; empty where there are fewer."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))


def window_keys(w: Column, length: int, window: int = WINDOW, k: int = K) -> Column:
    """One fingerprint for each run of ``length`` words, in order."""
    if length < window:
        return _grams(w, length)
    span = window - k + 1
    mins = _let(_grams(w, k), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda j: F.array_min(F.slice(h, j, span))))
    return F.when(F.size(w) >= window, mins).otherwise(F.array().cast("array<bigint>"))


def _runs(w: Column, length: int, window: int, k: int) -> Column:
    """``(length, key, first, last)`` of the stretches of neighbouring runs of words that have one fingerprint."""

    def of(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1))), lambda j: (F.size(h) > 0) & ((j == 1) | (F.get(h, j - 1) != F.get(h, j - 2))))
        return _let(starts, lambda s: F.transform(s, lambda x, i: F.struct(F.lit(length).alias("length"), F.get(h, x - 1).alias("key"), x.alias("first"), F.coalesce(F.get(s, i + 1) - 1, F.size(h)).alias("last"))))

    return _let(window_keys(w, length, window, k), of)


def _side(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Rows of ``docs (doc_id, text, ...)`` with what the benchmark shares with them.

    Adds ``n_words, n_hit, n_items, items (sorted item_ids as strings), spans
    (start and end of each covered run of words), contaminated`` to the columns
    of ``docs``; existing columns of those names are replaced.  A null or empty
    text has no words and no hits.  Equal rows get equal results.  A benchmark
    item without words matches nothing, one without an item_id counts as a hit
    but not as an item; an empty benchmark leaves all documents clean.
    """
    made = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated", "__row"]
    docs = docs.select(*(c for c in docs.columns if c not in made), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))).alias("__row"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("length"))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most one for each length up to the window
    keys = F.array().cast("array<bigint>")
    for n in lengths:
        keys = F.when(F.col("length") == n, window_keys(F.col("w"), n, window, k)).otherwise(keys)
    wins = checkpoint(items.select("item_id", "length", F.explode(F.arrays_zip(starts.alias("i"), keys.alias("key"))).alias("x"), "w").select("item_id", "length", F.col("x.key").alias("key"), F.array_join(F.slice("w", F.col("x.i"), F.col("length")), " ").alias("win")).distinct())
    n_wins, n_bytes = wins.agg(F.count("*"), F.sum(F.octet_length("win") + F.coalesce(F.octet_length("item_id"), F.lit(0)))).first()
    key_bytes, win_bytes = 64 * n_wins, 96 * n_wins + (n_bytes or 0)

    base = docs.select("*", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if lengths:
        split = docs.select("__row", words(F.col("text")).alias("w"))
        runs = split.select("__row", F.explode(_let(F.col("w"), lambda w: F.concat(*(_runs(w, n, window, k) for n in lengths)))).alias("r")).select("__row", "r.*")
        met = runs.join(_side(wins.select("length", "key").distinct(), key_bytes), ["length", "key"])
        # equal rows have one __row; what they share is made distinct below
        matched = checkpoint(met.groupBy("__row").agg(F.collect_set(F.struct("length", "first", "last")).alias("at")))
        size = 128 * matched.count() + 16 * (matched.agg(F.sum(F.size("at"))).first()[0] or 0)
        near = split.join(_side(matched, size), "__row")
        at = near.select("__row", "w", F.explode("at").alias("r")).select("__row", "w", "r.length", F.explode(F.sequence("r.first", "r.last")).alias("at"))
        found = at.select("__row", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("length")).alias("end"), F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("win"), "length")
        hits = checkpoint(found.join(_side(wins.select("item_id", "length", "win").distinct(), win_bytes), ["length", "win"]).select("__row", "start", "end", "item_id").distinct())
        items_of = hits.groupBy("__row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        reach = F.max("end").over(Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        by_start = hits.groupBy("__row", "start").agg(F.max("end").alias("end")).withColumn("new", F.coalesce(reach < F.col("start"), F.lit(True)).cast("int"))
        island = F.sum("new").over(Window.partitionBy("__row").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
        whole = by_start.withColumn("island", island).groupBy("__row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        spans_of = whole.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        base = base.join(spans_of.join(items_of, "__row"), "__row", "left")
    else:
        base = base.select("*", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), none.alias("items"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    kept = [c for c in base.columns if c not in ("__row", "spans", "items")]
    out = base.select(*kept, F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "spans")
    # size(null) is -1 or null by setting: count items from the filled array
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def op10_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row."""
    found = contamination(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
