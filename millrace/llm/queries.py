"""The registered queries of this package and the SQL that mirrors them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import load


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_dedup import op1_query

    return op1_query(load(spark, sf_dir, "documents"))


def op2_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.edit_fingerprint import op2_query

    return op2_query(load(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import op3_query

    return op3_query(load(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import op4_query

    return op4_query(load(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_counts import op5_query

    return op5_query(load(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_text import op6_query

    return op6_query(load(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import op7_query

    return op7_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_files import op8_query

    return op8_query(load(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ngram_join import op9_query

    return op9_query(load(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import op10_query

    return op10_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_edit_fingerprint, op3_bpe, op4_pii, op5_token_counts, op6_html_text, op7_toxicity, op8_token_files, op9_ngram_join, op10_decontaminate)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op9_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 85 * (i.n + j.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM i)),
x AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM v) WHERE len(ws) >= k)),
h AS (SELECT doc_id, item_id, p, v.k FROM x JOIN v ON x.win = v.win AND x.k = v.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}
