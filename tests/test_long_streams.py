"""What few keys share is spread over tasks, with the results of a plain version."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from plumbline.operators import kernels as K


@contextmanager
def many_partitions(spark):
    """16 shuffle partitions, none joined and no table broadcast by size: small tables are dealt out as large ones are."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df):
    """Of a DataFrame's rows the share that its fullest task holds."""
    every = F.bit_xor(F.xxhash64(*df.columns))  # so that no column is left out
    n = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), every).collect()]
    return max(n) / sum(n)


def streams():
    rng = random.Random(5)
    times = {"long": [rng.choice([None, float(rng.randrange(900))]) if i % 9 == 0 else float(rng.randrange(900)) for i in range(3000)], "short": [5.0, 3.0, None, 9.0], "one": [1.0], None: [4.0, 2.0]}
    return times, [(s, i, t) for s, ts in times.items() for i, t in enumerate(ts)]


def plain(times, kind):
    out = []
    for s, ts in times.items():
        rows = [(i, t) for i, t in enumerate(ts) if kind == "raw" or t is not None]
        rows = sorted(rows, key=lambda r: (r[1], r[0])) if kind == "sorted" else rows
        before = [None, *[t for _, t in rows]]
        out += [(s, i, None if t is None or b is None else t - b) for (i, t), b in zip(rows, before, strict=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["raw", "dropped", "sorted"])
def test_gaps_of_a_long_stream_are_taken_in_ranges(spark, kind):
    times, rows = streams()
    with many_partitions(spark):
        df = spark.createDataFrame(rows, "s string, row int, ts double").repartition(7)
        got = K.gaps(df, ["s"], ["row"], kind=kind)
        assert sorted([(r.s, r.row, r.gap_sec) for r in got.collect()], key=repr) == plain(times, kind)
        assert sorted(got.columns) == ["gap_sec", "row", "s", "ts"]
        assert largest_share(got) < 0.5


def test_steps_and_repeats_of_a_long_stream(spark):
    times, rows = streams()
    with many_partitions(spark):
        df = spark.createDataFrame(rows, "s string, row int, ts double").repartition(7)
        raw = plain(times, "raw")
        back = K.backward_steps(df, ["s"], ["row"])
        assert sorted([(r.s, r.row, r.delta_sec) for r in back.collect()], key=repr) == [x for x in raw if x[2] is not None and x[2] < 0]
        assert largest_share(back) < 0.5
        wide = K.large_gaps(df, ["s"], ["row"], 100)
        assert sorted([(r.s, r.row, r.gap_sec) for r in wide.collect()], key=repr) == [x for x in raw if x[2] is not None and x[2] > 100]
        (r,) = K.first_repeat(df, ["s"], ["row"]).collect()
        known = [t for t in times["long"] if t is not None]
        assert (r.s, r.surplus, r.first_repeat) == ("long", len(known) - len(set(known)), next(t for t in known if known.count(t) > 1))


def shuffled_rows(df):
    """Rows that the shuffles of a collected DataFrame have written."""
    n, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            n += node.metrics().apply("shuffleRecordsWritten").value()
        kids = node.children()
        left += [kids.apply(i) for i in range(kids.size())]
        left += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    return n


def test_equal_times_of_a_pair_are_shuffled_once(spark):
    with many_partitions(spark):
        df = spark.range(40_000).selectExpr("IF(id % 2 = 0, 'x', 'y') AS s", "IF(id % 2 = 0, 10 * (id % 7), 10 * (id % 11) + IF(id % 3 = 0, 2, 3)) AS t")
        near = K.nearest_gaps(df, "s", "t", from_left=True)
        (r,) = near.collect()
        x, y = ([10 * (i % 7) for i in range(0, 40_000, 2)], {10 * (i % 11) + (2 if i % 3 == 0 else 3) for i in range(1, 40_000, 2)})
        gaps = sorted(min(abs(t - u) for u in y) for t in x)
        assert (r.a, r.b, r.n, r.median_gap_sec, r.max_gap_sec) == ("x", "y", len(gaps), (gaps[9999] + gaps[10_000]) / 2, gaps[-1])
        assert 0 < shuffled_rows(near) < 20_000


def test_rows_of_a_hot_key_are_looked_up_in_several_tasks(spark):
    with many_partitions(spark):
        df = spark.range(6000).selectExpr("id", "CASE WHEN id % 10 < 5 THEN 'lost' WHEN id % 10 < 8 THEN 'kept' WHEN id % 10 = 8 THEN CAST(id AS string) END AS key", "map('a', id) AS open")
        ref = spark.range(0, 6000, 3).selectExpr("CAST(id AS string) AS name").union(spark.createDataFrame([("kept",), ("kept",), (None,)], "name string"))
        keys = {"kept", *(str(i) for i in range(0, 6000, 3))}
        want = [i for i in range(6000) if i % 10 < 5 or (i % 10 == 8 and str(i) not in keys)]
        found = K.broken_links(df, "key", ref, "name", rows=200)
        assert sorted(r.id for r in found.collect()) == want and found.columns == ["id", "key", "open"]
        assert largest_share(found.select("id", "key")) < 0.5
        every = K.broken_links(df, "key", ref, "name", guarded=False, rows=200)
        assert sorted(r.id for r in every.collect()) == sorted([*want, *range(9, 6000, 10)])
        assert largest_share(every.select("id", "key")) < 0.5
        assert K.broken_links(df, "key", ref.where("false"), "name", rows=200).count() == 0


def test_a_whole_table_is_numbered_in_ranges(spark):
    with many_partitions(spark):
        keys = [(i % 3, None if i % 7 == 0 else f"f{i % 5}", i) for i in range(3000)]
        df = spark.createDataFrame(keys, "place int, file string, row int").repartition(5)
        out = K.numbered(df, ["place", "file", "row"], "nth")
        assert out.columns == ["place", "file", "row", "nth"]
        want = sorted(keys, key=lambda k: (k[0], k[1] is not None, k[1] or "", k[2]))
        assert [(r.place, r.file, r.row) for r in sorted(out.collect(), key=lambda r: r.nth)] == want
        assert sorted(r.nth for r in out.collect()) == list(range(1, 3001))
        assert K.numbered(df.where("false"), ["row"], "nth").count() == 0
        assert [r.nth for r in K.numbered(df.limit(1), ["row"], "nth").collect()] == [1]


def test_findings_are_numbered_in_several_tasks(spark):
    from plumbline.plans.tables import QUERIES
    from plumbline.plans.tables_product import findings_in_order

    assert QUERIES["findings_in_order"] is findings_in_order
    with many_partitions(spark):
        assert largest_share(findings_in_order(spark, "/root/testdata/sf0.001")) < 0.5
