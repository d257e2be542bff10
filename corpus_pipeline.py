"""Five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; it is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``docs``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import checkpoint, load, remove, shared_folder
from millrace.llm.decontaminate import contamination
from millrace.llm.ngram_join import near_duplicates
from millrace.llm.pii import find_personal_data
from millrace.llm.toxicity import score, train


def _aside(docs: DataFrame, made: list[str], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use(docs)`` with the columns of ``docs``, those that share a name with what it makes set aside."""
    away = {c: f"__aside_{c}" for c in docs.columns if c in made}
    out = use(docs.withColumnsRenamed(away))
    return out.select(*(F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5 (null and empty texts among them)."""
    model = train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return _aside(docs, ["score"], lambda d: score(d, model, spans=False).where("score < 0.5"))


#: Words of a shingle, and the least likeness in hundredths, of the near-duplicate stage; those of the op9 query are its contract's.
WORDS, PERCENT = 5, 80


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (five-word shingles, 80 % alike): that of the least doc_id.

    Where doc_ids are missing or repeated, rows are numbered and stored first,
    and the row of the least number stays.  Texts without words all stay.
    """
    rows, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows == ids == distinct:
        kept = near_duplicates(docs, WORDS, PERCENT).where("doc_id = component_id").select("doc_id")
        return docs.join(kept, docs["doc_id"] == kept["doc_id"], "left_semi")
    numbered = checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
    kept = near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text"), WORDS, PERCENT).where("doc_id = component_id").select(F.col("doc_id").alias("__row"))
    return numbered.join(kept, "__row", "left_semi").select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    made = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated", "__row"]
    return _aside(docs, made, lambda d: contamination(d, load(spark, sf_dir, "benchmark")).where("not contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    out = _aside(docs, ["spans"], lambda d: find_personal_data(d, mask=True))
    if "n_chars" in out.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each document."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), lists=True).withColumnRenamed("decoded", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("bpe", bpe),
]

#: SQL cannot express the toxicity stage's model; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages."""
    docs, before = load(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            folder = shared_folder(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before is not None:
                remove(spark, before)  # the stage that read it is written
            before = folder
    return docs
