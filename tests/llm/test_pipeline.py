"""The pipeline's stages on their own input, and as a whole."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import P, WORDS, prose, tokenizers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, top = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, 70)
        if i % 6 == 0:
            text = text.replace(" ", " grumblefoo ", 4)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    bench = prose(random.Random(5), 25)
    rows[7] = (7, rows[1][1], "en", "s", 1)
    rows[8] = (8, rows[8][1] + " " + bench, "en", "s", 1)
    rows[9] = (9, rows[9][1] + " call +1 555 123 4567", "en", None, 1)
    rows += [(301, "", "en", "s", 0), (302, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = set(range(300)) | {301, 302}
    for (name, stage), gone in zip(cp.STAGES[:4], ({i for i in range(300) if i % 6 == 0}, {7}, {8}, set()), strict=True):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept -= gone
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == kept, name
        docs = out
    assert got[9].text.endswith("call [PHONE]") and got[9].n_chars == len(got[9].text) and got[302].text is None
    whole = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert set(whole) == kept
    t = tokenizers.Tokenizer.from_file(P.path(WORDS))
    assert all(whole[i].ids == t.encode(got[i].text or "", add_special_tokens=False).ids for i in kept)


def test_personal_data_is_masked_wherever_it_stands(spark, folder):
    filler = " ".join(["the river runs slowly past the old stone houses"] * 60)
    text = f"{filler}. Please write to max.berger at example.org before noon. {filler}"
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    out = cp.pii(spark, docs, folder).first()
    assert out.text == text.replace("max.berger at example.org", "[EMAIL]") and out.n_chars == len(out.text)


def test_clashing_columns_and_odd_rows(spark, folder):
    names = ["score", "spans", "n_words", "items", "contaminated", "__row"]
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "p q r s t"), (4, "p q r s t"), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, *"uvwxyz") for i, t in rows], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {r.score for r in out.collect()} == {"u"} and out.count() == (4 if name == "ngram_join" else 6), name
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0
    assert cp.STAGES[4][1](spark, docs, folder).count() == 6


@pytest.mark.parametrize("numbered", [True, False])
def test_near_copies_between_80_and_85_percent_go(spark, numbered):
    rng = random.Random(21)
    base, other = ([f"w{rng.randint(0, 10**9)}" for _ in range(100)] for _ in range(2))
    more = [f"m{i}" for i in range(26)]
    # 5-word likeness: 96 of 116 (0.828), 96 of 120 (0.8 exactly), then 96 of 121
    rows = [(1, base), (2, base + more[:20]), (3, other), (4, other + more[:24]), (5, base[::-1]), (6, base[::-1] + more[:25])]
    docs = spark.createDataFrame([(i if numbered else None, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1)
    got = sorted(len(r.text.split()) for r in cp.ngram_join(spark, docs, "").collect())
    assert got == [100, 100, 100, 125]
