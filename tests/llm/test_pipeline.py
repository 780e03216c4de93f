"""The pipeline against its parts, each judged on its own input."""

import random

import corpus_pipeline
import pyarrow as pa

from plumbline.llm import toxicity
from plumbline.llm.common import small_batches


def test_run_is_its_stages_in_order(spark, tmp_path):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(800)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randrange(40, 120)), "en", rng.choice(["s1", "s2", None])) for i in range(200)]
    labels = []
    for i in range(0, 200, 4):
        docs[i] = (i, docs[i][1] + " dolt cur dolt", *docs[i][2:])
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    leak = text(30)
    docs += [(300, docs[1][1], "en", "s1"), (301, docs[1][1] + " more", "en", "s1"), (302, f"{text(20)} {leak}", "en", "s2"), (303, None, None, None)]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")

    assert len(corpus_pipeline.STAGES) == 5
    df, ids = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = df
        df = spark.createDataFrame(stage(spark, df, path).collect(), df.schema)
        assert df.columns == before.columns
        ids.append({r.doc_id for r in df.collect()})
    toxic, near, clean, mixed = ids
    assert not toxic & set(range(0, 200, 4)) and len(toxic) >= 150
    assert 1 in near and not near & {300, 301}
    assert 302 in near and 302 not in clean and near - clean == {302}
    assert mixed <= clean
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == mixed and len(out) == df.count()
    assert toxicity.THRESHOLD == 0.3


def tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, doc int, __mix string, __score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, str(tmp_path / "sf"), [], [], [])).collect() == []


def test_run_with_long_null_and_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long = text(60_000)
    docs = [(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, text(50), "en", "b"), (5, text(50), "en", "b"), (None, text(20), "en", "b"), (6, text(90), None, "b")]
    path = tables(spark, str(tmp_path / "sf"), [(*d, 0, 7, "own", 0.5) for d in docs], [(5, 1, 0), (6, 1, 0)], [(None, None), (1, text(20))])
    df = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, path)
        assert after.columns == df.columns
        df = spark.createDataFrame(after.collect(), df.schema)
    kept = {r.doc_id for r in df.collect()}
    assert 1 in kept and 2 not in kept and all((r.doc, r["__mix"], r["__score"]) == (7, "own", 0.5) for r in df.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == kept


def test_stages_hand_workers_rows_of_bounded_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(200, numPartitions=1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 200000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    for name in ("simhash near-dedup", "token store"):
        spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), "")
        assert texts.mapInArrow(sizes, "n bigint").agg({"n": "max"}).first()[0] < 6e6
    spark.conf.set(key, "1m")
    small_batches(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
