import hashlib
import random
from fractions import Fraction

import pytest

from plumbline.llm import mixing


def plain_targets(sizes):
    """Reshare by weight until no source is above its ceiling, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = Fraction(3 * sum(sizes.values()), 2), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
        left -= sum(out[s] for s in over)
        free -= over
    return out


def made(n=400):
    rng = random.Random(12)
    sources = ["hot"] * 6 + ["a", "b", "é", "Z", None, "tiny"]
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), rng.choice(sources)) for i in range(n)]
    return [*docs, (900, None, "a"), (901, "", "only empty"), (None, "x y z", "a"), (5, *docs[5][1:]), (902, "w " * 30_000, "b")]


def run(spark, tmp_path, docs, name="sf", **kw):
    path = str(tmp_path / name)
    spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id bigint, text string, source string, size int").repartition(kw.get("parts", 3)).write.parquet(f"{path}/documents.parquet")
    return mixing.op3_mixing(spark, path).collect()


def test_targets_and_exact_budgets(spark, tmp_path):
    docs = made()
    got = run(spark, tmp_path, docs)
    assert len(got) == len(docs)
    sizes, taken, targets = {}, {}, {}
    source = {d[0]: d[2] for d in docs}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        targets[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    for s, t in plain_targets(sizes).items():
        assert targets[s] == pytest.approx(float(t)) and abs(taken[s] - targets[s]) <= 1.5, s
    again = run(spark, tmp_path, docs[::-1], "again", parts=7)
    key = lambda rows: sorted((repr(r.doc_id), r.taken) for r in rows)
    assert key(got) == key(again)


def test_small_ranges_give_the_same_mix(spark):
    docs = spark.createDataFrame(made(), "doc_id bigint, text string, source string")
    rows = []
    for n in (3, 10_000):
        _, edges = mixing.mixture(docs, rows_per_range=n)
        rows.append(sorted(map(str, edges.collect())))
    assert rows[0] == rows[1]


def test_order_within_a_source_is_by_hash(spark, tmp_path):
    docs = [(i, "a b c d", "s") for i in range(50)] + [(100 + i, "a b c d", "t") for i in range(50)]
    got = {r.doc_id: r.taken for r in run(spark, tmp_path, docs)}
    for base in (0, 100):
        order = sorted(range(base, base + 50), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        counts = [got[i] for i in order]
        assert counts == sorted(counts, reverse=True)


def test_stage_and_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    docs = spark.createDataFrame([(*d, 1) for d in made(3000)[:-1]], "doc_id bigint, text string, source string, __keep int")
    mixed = mixing.stage(spark, docs, "")
    assert mixed.columns == docs.columns
    words = mixed.select(mixing.word_count("text").alias("n")).agg({"n": "sum"}).first()[0]
    every = docs.select(mixing.word_count("text").alias("n")).agg({"n": "sum"}).first()[0]
    assert words == pytest.approx(1.5 * every, rel=0.02)
