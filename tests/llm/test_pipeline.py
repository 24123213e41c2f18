import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import bpe, line_dedup, mixing, quality_rules, simhash_dedup
from evenkeel.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns_and_take_effect(spark, docs, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, folder).cache()
        assert now.columns == docs.columns, name
        seen.append((before, now.count()))
    assert seen[0][1] < seen[0][0] and seen[1][1] == seen[1][0] and seen[2][1] < seen[2][0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "bpe_encoding"]


def test_columns_of_any_name_stay(spark, docs, folder):
    """Columns that the operators use themselves come through all stages unchanged; other rows do too."""
    names = ["kept", "n_words", "n_lines", "n_dropped", "kept_text", "upper_share", "base_failed", "copies", "root", "size", "mix_key", "_column_0"]
    now, plain = docs.select("*", *[F.lit("mine").alias(n) for n in names]), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, plain = stage(spark, now, folder).cache(), stage(spark, plain, folder).cache()
        assert now.columns == [*docs.columns, *names], name
        assert now.where(" AND ".join(f"{n} = 'mine'" for n in names)).count() == now.count() > 0
        assert sorted(map(str, now.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))


def test_empty_table_and_rows_without_own_ids(spark, docs, folder, tmp_path):
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(10**5)}" for _ in range(80)) for _ in range(9)]
    rows = [(i, t, "en", "hot" if k % 3 else None, 1) for k, (i, t) in enumerate(zip([None, None, -1, 7, 7, 7, None, 8, 9], texts))]
    own = spark.createDataFrame([*rows, rows[0], rows[3]], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        own = stage(spark, own, folder).cache()
    assert sorted(r["text"] for r in own.collect()) == sorted(texts)


def test_run_equals_the_operators_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality_rules.judge_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept").select(*docs.columns).cache()
    lines = line_dedup.dedup_lines(kept, batch_lines=10**6).drop("text").withColumnRenamed("kept_text", "text").cache()
    mixed = mixing.mixed_documents(simhash_dedup.keep_similar_one(lines)).cache()
    want = bpe.encode_documents(mixed, tokenizer_path("word_bpe_49k.json"), digests=True)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
