"""Kernels against plain versions, with ranges small enough to have edges."""

import random
import statistics
import time
from bisect import bisect_left

import pytest

from plumbline.operators import kernels as K


def nearest(streams, from_left=False):
    out = {}
    for a in streams:
        for b in streams:
            if a < b:
                ask, target = (a, b) if from_left or len(streams[a]) <= len(streams[b]) else (b, a)
                gaps = [min(abs(t - u) for u in streams[target]) for t in streams[ask]]
                out[a, b] = (len(gaps), statistics.median(gaps), max(gaps))
    return out


@pytest.mark.parametrize("slot", [3, 7, 1_000_000])
def test_nearest_gaps_over_the_edges_of_slots(spark, slot):
    rng = random.Random(slot)
    streams = {"p": [rng.randrange(500) for _ in range(40)], "q": [rng.randrange(900) for _ in range(25)], "r": [7] * 4, "s": [rng.randrange(100, 110) for _ in range(40)]}
    df = spark.createDataFrame([(s, t) for s, ts in streams.items() for t in [*ts, None]], "s string, t bigint")
    for left in (False, True):
        got = {(r.a, r.b): (r.n, r.median_gap_sec, r.max_gap_sec) for r in K.nearest_gaps(df, "s", "t", from_left=left, rows_per_slot=slot).collect()}
        assert got == nearest(streams, left)


def test_a_long_pair_takes_no_quadratic_time(spark):
    df = spark.range(200_000).selectExpr("IF(id % 2 = 0, 'x', 'y') AS s", "(id * 7919) % 1000003 AS t")
    began = time.time()
    (row,) = K.nearest_gaps(df, "s", "t").collect()
    assert time.time() - began < 60
    x, y = ([(i * 7919) % 1000003 for i in range(k, 200_000, 2)] for k in (0, 1))
    y.sort()
    gaps = []
    for t in x:
        i = bisect_left(y, t)
        gaps.append(min(abs(t - u) for u in y[max(0, i - 1) : i + 1]))
    assert (row.n, row.median_gap_sec, row.max_gap_sec) == (len(x), statistics.median(gaps), max(gaps))


def test_each_two_streams_are_paired_once(spark):
    names = [f"n{i:03d}" for i in range(70)]
    got = [(r.a_s, r.b_s) for r in K.pairs(spark.createDataFrame([(n,) for n in names], "s string"), "s").collect()]
    assert sorted(got) == [(a, b) for a in names for b in names if a < b]
