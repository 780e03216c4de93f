import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from plumbline.llm import toxicity as tx


def plain_logits(e, start, a):
    out = np.zeros(len(e))
    bounds = [*np.flatnonzero(start), len(e)]
    for s, t in zip(bounds[:-1], bounds[1:], strict=True):
        phi = np.stack([np.ones(t - s), np.exp(e[s:t])], 1)
        al, be = phi.copy(), np.ones_like(phi)
        for i in range(1, t - s):
            al[i] = phi[i] * (al[i - 1] @ a)
            al[i] /= al[i].sum()
        for i in range(t - s - 2, -1, -1):
            be[i] = a @ (phi[i + 1] * be[i + 1])
            be[i] /= be[i].sum()
        out[s:t] = np.log(al[:, 1] * be[:, 1]) - np.log(al[:, 0] * be[:, 0])
    return out


def test_marginals_are_exact_for_any_layout():
    rng = np.random.default_rng(0)
    for n in (1, 2, 31, 300, 5000):
        start = rng.random(n) < 0.02
        start[0] = True
        e, a = rng.normal(size=n) * 3, np.exp(rng.normal(size=(2, 2)))
        assert np.allclose(tx.marginals(e, start, a)[0], plain_logits(e, start, a))


def corpus(n, seed):
    rng = random.Random(seed)
    calm = [f"word{i}" for i in range(400)]
    rude = ["dolt", "cur", "gnarlish", "gnarlage", "gnarler"]
    rows = []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_held_out_accuracy_spans_and_odd_rows(spark, tmp_path):
    rows = corpus(600, 1)
    docs = [(i, t, "en") for i, t, _ in rows] + [(1000, None, None), (1001, "", "en"), (1002, "?! ...", "en"), (None, "dolt", "en"), (1003, "word1 " * 50_000 + "dolt", "en"), (5, rows[5][1], "en")]
    labels = [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (5000, 1, 1)]
    path = tables(spark, str(tmp_path / "sf"), docs, labels)
    got = tx.op1_toxicity(spark, path).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[1003].predicted == 1 and by[1003].spans[-1].start == 6 * 50_000
    assert by[1000].score == by[1001].score and by[1002].predicted == 0
    kept = tx.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id for r in kept.collect()} >= {r.doc_id for r in got if not r.predicted}


def test_without_labels_or_rows(spark, tmp_path):
    path = tables(spark, str(tmp_path / "a"), [(1, "a b", "en")], [])
    assert [(r.score, r.predicted) for r in tx.op1_toxicity(spark, path).collect()] == [(0.0, 0)]
    path = tables(spark, str(tmp_path / "b"), [], [(1, 1, 1)])
    assert tx.op1_toxicity(spark, path).count() == 0


def test_clashing_columns_and_text_ids(spark):
    rows = corpus(80, 3)
    docs = spark.createDataFrame([(f"d{i}", t, i, i + 1) for i, t, _ in rows], "doc_id string, text string, __score int, __spans int")
    model = tx.fitted(docs, spark.createDataFrame([(f"d{i}", y) for i, _, y in rows], "doc_id string, toxic int"))
    tagged = tx.tag(docs, model).collect()
    assert tagged[0].__fields__ == ["doc_id", "text", "__score", "__spans"] and all(0 <= r["__score"] <= 1 for r in tagged)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_held_out_labels_of_the_tables(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in tx.op1_toxicity(spark, path).collect() if r.held_out and truth.get(r.doc_id) is not None]
    toxic, calm = ([r.score for r in got if truth[r.doc_id] == y] for y in (1, 0))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in calm])
    assert above > 0.7 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.9


def test_fitting_holds_few_bytes_a_token():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(500)) for _ in range(200)]
    labels = np.array([w.endswith("77") for t in texts for w in t.split()])
    tracemalloc.start()
    tx.fit_tokens(texts, labels, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 170 * len(labels)


def test_sums_in_blocks_are_those_of_bincount():
    rng = np.random.default_rng(5)
    at, values = rng.integers(0, 50, 1000), rng.normal(size=1000)
    assert (tx._summed(60, at, lambda part: values[part], block=7) == np.bincount(at, values, 60)).all()
