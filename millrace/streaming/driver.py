"""Views over streams of changes, and optimistic writes ahead of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import changes as ch
from millrace.sources.catalog import Catalog
from millrace.streaming.views import Engine


def follow(engine: Engine, table: str, folder: str, checkpoint: str, files_per_batch: int = 1, on_batch: Callable[[int, dict[str, DataFrame]], None] | None = None) -> StreamingQuery:
    """Apply the change files (parquet, see ``change_schema``) of a folder as they come; stops when none are left.

    A micro-batch that is delivered again after a failure has an id that was
    applied already, and is skipped.
    """
    schema = ch.change_schema(engine.catalog[table])
    source = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def apply(df: DataFrame, batch_id: int) -> None:
        out = engine.apply({table: df}, batch_id=batch_id)
        if on_batch is not None:
            on_batch(batch_id, out)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grouped_counts(source: DataFrame, by: list[str], watermark: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Counts of an append-only stream by columns; the state of finished groups goes with a watermark."""
    if watermark is not None:
        source = source.withWatermark(watermark, delay)
    return source.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def assembled_text(chunks: DataFrame, by: list[str], seq: str = "seq", text: str = "text") -> DataFrame:
    """The text of each stream from its durable chunks, in sequence; a chunk that came twice counts once."""
    once = chunks.dropDuplicates([*by, seq])
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text"))))
    return once.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias(text))


def chunked_text(deltas: DataFrame, by: list[str], chars: int = 512, interval_ms: int = 750) -> DataFrame:
    """``(by, seq, text)`` chunks to be stored of each stream's live ``deltas (by, seq, at_ms, text)``.

    A chunk closes with the delta that brings it to ``chars`` characters or that
    comes ``interval_ms`` after the last chunk, and at the end; ``seq`` is the
    number of characters before it.  Null and empty deltas add nothing.
    """
    kind = "array<struct<seq:bigint,text:string>>"
    first = F.struct(F.lit(None).cast(kind).alias("done"), F.lit("").alias("held"), F.lit(0).cast("long").alias("seq"), F.col("items")[0]["at_ms"].alias("since"))
    first = first.withField("done", F.array().cast(kind))

    def closed(acc, held):
        return F.concat(acc["done"], F.array(F.struct(acc["seq"].alias("seq"), held.alias("text"))))

    def step(acc, x):
        held = F.concat(acc["held"], x["text"])
        full = (F.length(held) >= chars) | (x["at_ms"] - acc["since"] >= interval_ms)
        then = F.struct(closed(acc, held).alias("done"), F.lit("").alias("held"), (acc["seq"] + F.length(held)).alias("seq"), x["at_ms"].alias("since"))
        return F.when(full, then).otherwise(F.struct(acc["done"].alias("done"), held.alias("held"), acc["seq"].alias("seq"), acc["since"].alias("since")))

    def end(acc):
        return F.when(F.length(acc["held"]) > 0, closed(acc, acc["held"])).otherwise(acc["done"])

    rows = deltas.where("length(text) > 0").select(*by, F.struct("seq", F.col("at_ms").cast("long").alias("at_ms"), "text").alias("item"))
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return held.select(*by, F.explode(F.aggregate("items", first, step, end)).alias("chunk")).select(*by, "chunk.seq", "chunk.text")


def spliced_text(durable: DataFrame, live: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Each stream's stored text, and what its live text has beyond that.

    Both are beginnings of one text, so the longer one continues the other.  A
    stream that is in one frame only is as it is there; of several live texts
    of a stream the longest counts; null is empty.
    """
    made = live.groupBy(*by).agg(F.max_by(text, F.length(text)).alias("__live"))
    both = durable.select(*by, text).join(made, by, "full_outer")
    held, more = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col("__live"), F.lit(""))
    return both.select(*by, F.concat(held, F.substr(more, F.length(held) + 1)).alias(text))


class Optimistic:
    """Local writes shown before they are confirmed.

    ``sync`` is the confirmed state, ``engine`` holds it with the pending
    mutations made on top.  A confirmed change moves ``sync`` on, takes the head
    back to it, and makes the mutations that are still pending again.
    """

    def __init__(self, engine: Engine):
        self.engine, self.sync = engine, Catalog(dict(engine.catalog.tables))
        self.pending: list[tuple[str, Callable[[Catalog], dict[str, DataFrame]]]] = []

    def mutate(self, name: str, mutation: Callable[[Catalog], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Make a mutation (a function from the tables to a batch) at once."""
        out = self.engine.apply(mutation(self.engine.catalog))
        self.pending.append((name, mutation))
        return out

    def confirm(self, batch: dict[str, DataFrame], done: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """Take a confirmed batch, which settles the mutations named in ``done``; the views' changes."""
        moved = {n: ch.applied(self.sync[n], ch.net(self.sync[n], df)) for n, df in batch.items()}
        self.sync = self.sync.replaced(moved)
        self.pending = [(n, m) for n, m in self.pending if n not in done]
        target = Catalog(dict(self.sync.tables))
        for _, m in self.pending:
            target = target.replaced({n: ch.applied(target[n], ch.net(target[n], df)) for n, df in m(target).items()})
        return self.engine.apply({n: _towards(self.engine.catalog, target, n) for n in target.tables})


def _towards(head: Catalog, target: Catalog, name: str) -> DataFrame:
    t = head[name]
    schema = ch.change_schema(t)
    delta = ch.difference(t.df, target[name].df, list(t.key))
    return delta.select(F.lit(0).cast("long").alias("seq"), "op", F.col("old").cast(schema["old"].dataType).alias("old"), F.col("new").cast(schema["new"].dataType).alias("new"))
