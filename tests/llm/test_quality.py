import os
import random

import numpy as np
import pytest
import regex

from plumbline.llm import quality


def corpus(n):
    rng = random.Random(9)
    vocab = [f"{rng.choice(['stone', 'river', 'hand', 'wind'])}{rng.choice('abcdefgh')}{rng.choice('xyzuvw')}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) if rng.random() > 0.25 else rng.choice(["the", "of", "and", "to"]) for _ in range(rng.randrange(30, 200))]
        kind = i % 8
        if kind == 0:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
        elif kind == 1:
            text = "!! ".join(words).upper()
        elif kind == 2:
            text = " ".join(w for w in words[:8] for _ in range(20))
        else:
            text = " ".join(w + ("." if j % 11 == 10 else "") for j, w in enumerate(words))
        rows.append((i, text, int(kind > 2)))
    return rows


def test_weak_labels_find_junk(spark, tmp_path):
    rows = corpus(640)
    odd = [(None, "the end."), (2000, None), (2001, ""), (2002, "x" * 200_000), (2003, rows[5][1]), (2003, rows[5][1])]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    got = quality.op4_quality(spark, path).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.keep == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]) > 0.97


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    accuracy = [0.95, 0.85, 0.75, 0.9]
    y = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(len(y)) < 0.8, np.where((rng.random(len(y)) < a) == y, 1, -1), 0) for a in accuracy], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float), rounds=500)
    assert np.allclose(model.accuracy(), accuracy, atol=0.02) and abs(model.prior - 0.7) < 0.02


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    assert quality.op4_quality(spark, path).count() == 0


def plain_votes(text):
    """The labellers, one text at a time."""
    t = text or ""
    words = [w for w in regex.split("[ \t-\r]+", t) if w]
    n, count = len(words), lambda pattern: len(regex.findall(pattern, t))
    letters, per = count(r"\p{L}"), max(n, 1)
    stops = "|".join(quality.STOP_WORDS)
    repeats = count(r"(?<!\S)(\S+)\s(?=\1(?!\S))") / per
    symbols, shouting = count(r"[#$%&*|<>{}\[\]\\^~_=+@]") / max(len(t), 1), count(r"\p{Lu}") / max(letters, 1)
    variety, bare, ends = len(set(words)) / per, count(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)") / per, count(r"[.!?,;:](?!\S)") / per
    loud, stop, mean, enough = count(r"[^\p{L}\p{N}\s]{2}(?!\S)") / per, count(rf"(?<!\S)({stops})(?!\S)") / per, letters / per, n >= 20
    vote = lambda poor, good: -1 if poor else int(good)
    return [
        vote(symbols > 0.08, symbols < 0.02),
        vote(shouting > 0.5, shouting < 0.25),
        vote(repeats > 0.15, enough and repeats < 0.04),
        vote(enough and variety < 0.12, enough and variety > 0.2),
        vote(bare > 0.15, bare < 0.03),
        vote(enough and (ends < 0.005 or ends > 0.6), enough and 0.02 <= ends <= 0.4),
        vote(loud > 0.3, loud < 0.05),
        vote(enough and stop < 0.02, enough and 0.06 < stop < 0.6),
        vote(mean < 2 or mean > 14, 3 <= mean <= 10),
        vote(n < 5, n >= 40),
    ]


def test_query_against_plain(spark, tmp_path):
    rows = [(i, t) for i, t, _ in corpus(160)] + [(None, "the end."), (900, None), (901, ""), (902, "x" * 70_000), (903, "\t a b\x0b\r\n"), (4, corpus(5)[4][1])]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    cast = np.array([plain_votes(t) for _, t in rows])
    # EM document by document
    good = np.where((cast < 0).any(1), 0.1, np.where((cast > 0).any(1), 0.9, 0.5))
    for _ in range(100):
        weight = np.stack([1 - good, good])
        p = np.array([[[weight[c] @ (cast[:, j] == v) + 0.1 for v in (-1, 1)] for c in (0, 1)] for j in range(10)])
        p /= p.sum(2, keepdims=True)
        prior = np.clip((good.sum() + 0.1) / (len(rows) + 0.2), 0.01, 0.99)
        odds = np.log(prior / (1 - prior)) + sum(np.where(cast[:, j] == 0, 0, np.log(p[j, 1, (cast[:, j] + 1) // 2]) - np.log(p[j, 0, (cast[:, j] + 1) // 2])) for j in range(10))
        after = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(after - good).max() < 1e-6:
            break
        good = after
    # each different (id, text) up to the length limit trains once
    train = {(i, t or ""): g for (i, t), g in zip(rows, good, strict=True) if len(t or "") <= 60_000}
    scorer = quality.fit_scorer([t for _, t in train], np.array(list(train.values())))
    want = {}
    for i, t in rows:
        b, x = quality.features(t)
        want[i, t] = 1 / (1 + np.exp(-(scorer.bias + scorer.weights[b] @ x)))
    got = quality.score(spark.createDataFrame(rows, "doc_id bigint, text string"), quality.train(spark.read.parquet(f"{path}/documents.parquet"))[0]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["__quality"] == pytest.approx(want[r.doc_id, r.text], abs=1e-4)
    assert sorted(r.score for r in quality.op4_quality(spark, path).collect()) == pytest.approx(sorted(want[k] for k in ((i, t) for i, t in rows)), abs=1e-4)


def auc(scores, truth):
    scores, truth = np.asarray(scores), np.asarray(truth, bool)
    good, poor = np.sort(scores[truth]), np.sort(scores[~truth])
    return (np.searchsorted(poor, good).sum() + np.searchsorted(poor, good, "right").sum()) / (2 * len(good) * len(poor))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_scores_rank_labels_that_it_never_saw(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in quality.op4_quality(spark, path).collect() if r.doc_id in truth]
    assert auc([r.score for r in got], [truth[r.doc_id] for r in got]) > 0.97


def test_clashing_columns_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two", 3), ("b", None, 4)], "doc_id string, text string, __quality int")
    out = quality.score(docs, quality.train(docs)[0])
    assert out.columns == ["doc_id", "text", "__quality"] and all(0 <= r["__quality"] <= 1 for r in out.collect())
