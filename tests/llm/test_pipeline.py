"""The pipeline's stages on a small corpus."""

import random

import pytest

import corpus_pipeline


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "re", "in", "on", "sh", "er", "an"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    at = str(tmp_path_factory.mktemp("corpus"))
    item = prose(rng, 30)
    rows = [(i, prose(rng, 80) + "\n" + prose(rng, 20), "en") for i in range(40)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1].replace("the", "The", 1) + " more", "en"), (102, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en")]
    rows += [(103, None, "en"), (104, "123 456 !!", "en"), (105, "", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run(spark, folder):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == set(range(40)) | ({100} & set(rows)) and len(rows) <= 41  # one emptied copy may stand for all empty texts
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
