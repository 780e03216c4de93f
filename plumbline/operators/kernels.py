"""Rule kernels: DataFrame in, rows that break the rule out.

Every kernel takes column names, so one piece of code runs on a folder's CSV
streams and on any table.  ``ts`` is a time column, ``per`` how many of its
units make a second (1 for seconds, 1e6 for whole microseconds; differences
are taken before the one division).  Four meanings of "gap" exist and are kept
apart:

* ``raw``: to the row before in file order, nulls in place (a null breaks two),
* ``dropped``: file order, nulls taken out first,
* ``sorted``: time order, nulls taken out,
* per track: time order inside (file, track), order column as tie-breaker.

A stream can be as long as the input, so gaps along streams are taken in ranges
of (stream, order); tracks are short, so each is one window (``ranged=False``).
Aggregates combine before their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import exprs as X


def _window(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def seconds(delta: Column, per: float) -> Column:
    return delta / F.lit(float(per))


def gaps(df: DataFrame, part: list[str], order: list[str], ts: str = "ts", kind: str = "raw", per: float = 1.0, ranged: bool = True, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with ``gap_sec`` to the row before, in one of the meanings above; ``only`` keeps rows by their gap."""
    if kind != "raw":
        df = df.where(F.col(ts).isNotNull())
    order = [ts, *order] if kind == "sorted" else order
    gap = lambda w: seconds(F.col(ts) - F.lag(ts).over(w), per)
    out = _ranged_gaps(df, part, order, gap, only) if ranged else df.withColumn("gap_sec", gap(_window(part, order)))
    return out if only is None else out.where(only(F.col("gap_sec")))


def _ranged_gaps(df: DataFrame, part: list[str], order: list[str], gap: Callable[[Window], Column], only: Callable[[Column], Column] | None) -> DataFrame:
    """Gaps of streams of any length: no task holds a whole stream.

    Rows are dealt out in ranges of (stream, order), and a window runs in each
    range.  What it can't know are the gaps of its first rows: those come from a
    window over the first and last rows of all ranges of a stream.  It is one
    chain, so the ranges are cut once, wherever the cuts fall.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    inside, edges = Window.partitionBy(*part, "__range").orderBy(*by), Window.partitionBy(*part, "__edge").orderBy("__range", F.col("__first").desc())
    d = df.repartitionByRange(*part, *by).withColumn("__range", F.spark_partition_id())
    d = d.withColumns({"gap_sec": gap(inside), "__first": F.row_number().over(inside) == 1, "__last": F.lead(F.lit(1)).over(inside).isNull()})
    at_edge = F.col("__first") | F.col("__last")
    if only is not None:
        d = d.where(at_edge | only(F.col("gap_sec")))
    d = d.withColumn("__edge", F.when(at_edge, F.lit(-1)).otherwise(F.col("__range")))
    return d.withColumn("gap_sec", F.when(F.col("__first"), gap(edges)).otherwise(F.col("gap_sec"))).drop("__range", "__first", "__last", "__edge")


#: A table of one row a stream is paired in this many blocks each way, so no task holds all pairs.
PAIR_BLOCKS = 16


def _paired(streams: DataFrame, name: str) -> DataFrame:
    """a_*, b_* of each two streams, a before b by name.

    A stream's left copies go to the cells (own block, every block), its right
    copies to (every block, own block): two streams meet in one cell, by an
    ordinary join on the cell.
    """
    own, every = F.pmod(F.xxhash64(name), F.lit(PAIR_BLOCKS)), F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(PAIR_BLOCKS)]))
    a = streams.select(own.alias("__i"), every.alias("__j"), *[F.col(c).alias(f"a_{c}") for c in streams.columns])
    b = streams.select(every.alias("__i"), own.alias("__j"), *[F.col(c).alias(f"b_{c}") for c in streams.columns])
    return a.join(b, ["__i", "__j"]).where(F.col(f"a_{name}") < F.col(f"b_{name}")).drop("__i", "__j")


#: A key of more rows than this is dealt out to several tasks of a join.
HOT_ROWS = 250_000


def _spread(df: DataFrame, key: str, other: DataFrame, other_key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with ``__salt``: rows of a hot key of ``df`` get one of several salts, those of ``other`` all of them.

    There is at most one hot key for each ``rows`` rows, so their table is broadcast.
    """
    hot = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.ceil(F.count(F.lit(1)) / rows).alias("__salts")).where("__salts > 1")
    known = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*known), F.when(F.col(key).isNull(), F.lit(2**31)).otherwise(F.col("__salts")))  # nothing meets a null key, so it may have any salt
    salt = F.when(F.col(key).isNotNull() & F.col("__salts").isNull(), F.lit(0).cast("bigint")).otherwise(spread)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__salts", F.lit(1)) - 1))
    a = df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").select(*df.columns, salt.alias("__salt"))
    b = other.join(F.broadcast(hot), F.col(other_key) == F.col("__hot"), "left").select(*other.columns, every.alias("__salt"))
    return a, b


# -- timestamps ---------------------------------------------------------------


def backward_steps(df: DataFrame, part: list[str], order: list[str], ts: str = "ts", per: float = 1.0, ranged: bool = True) -> DataFrame:
    """Rows earlier than the row before them."""
    return gaps(df, part, order, ts, "raw", per, ranged, lambda g: g < 0).withColumnRenamed("gap_sec", "delta_sec")


def large_gaps(df: DataFrame, part: list[str], order: list[str], threshold: float, ts: str = "ts", per: float = 1.0) -> DataFrame:
    return gaps(df, part, order, ts, "raw", per, only=lambda g: g > threshold)


def repeated_values(df: DataFrame, part: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Second and later rows of a value in its stream; nulls equal each other."""
    nth = F.row_number().over(_window([*part, ts], order))
    return df.withColumn("__nth", nth).where("__nth > 1").drop("__nth")


def shared_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


# -- sensors ------------------------------------------------------------------


def _positive(c: str = "gap_sec") -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def observed_rates(df: DataFrame, part: list[str], order: list[str], ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Per stream of two or more times: 1 / mean of its positive gaps in file order."""
    g = gaps(df, part, order, ts, "dropped", per).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.avg(_positive()).alias("mean_gap"))
    return g.where((F.col("n") >= 2) & F.col("mean_gap").isNotNull()).select(*part, (1 / F.col("mean_gap")).alias("observed_hz"))


def off_rates(df: DataFrame, part: list[str], order: list[str], rates: DataFrame, tolerance: float, ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Streams whose rate is off the expected one (``rates``: part columns, expected_hz) by more than a share."""
    both = observed_rates(df, part, order, ts, per).join(rates, part)
    return both.where(F.abs(F.col("observed_hz") - F.col("expected_hz")) / F.col("expected_hz") > tolerance)


def missing_frames(df: DataFrame, part: list[str], order: list[str], multiplier: float, rates: DataFrame | None = None, ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Rows after a gap longer than a multiple of the expected one: 1 / configured rate, else the median positive gap."""
    g = gaps(df, part, order, ts, "dropped", per)
    every = g.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"), F.median(_positive()).alias("__median")).where("__n >= 3")
    expected = F.col("__median")
    if rates is not None:
        every = every.join(rates, part, "left")
        expected = F.coalesce(1 / F.col("expected_hz"), expected)
    every = every.select(*part, expected.alias("expected_gap_sec"))
    return g.join(every, part).where(F.col("gap_sec") > F.col("expected_gap_sec") * multiplier)


# -- synchronisation ----------------------------------------------------------


def timings(df: DataFrame, part: list[str], ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Start, end, span, count, median and largest positive gap, and rate of each stream."""
    g = gaps(df, part, [], ts, "sorted", per)
    out = g.groupBy(*part).agg(
        seconds(F.min(ts), per).alias("start_time"),
        seconds(F.max(ts), per).alias("end_time"),
        seconds(F.max(ts) - F.min(ts), per).alias("duration_sec"),
        F.count(F.lit(1)).alias("frame_count"),
        F.median(_positive()).alias("median_dt_sec"),
        F.max(_positive()).alias("max_dt_sec"),
    )
    return out.withColumn("inferred_frequency_hz", F.try_divide(F.lit(1.0), F.col("median_dt_sec")))


def overlap(times: DataFrame) -> DataFrame:
    """One row: number of streams, latest start, earliest end, length of the shared range."""
    t = times.agg(F.count(F.lit(1)).alias("streams"), F.max("start_time").alias("shared_start"), F.min("end_time").alias("shared_end"))
    return t.withColumn("overlap_sec", F.greatest(F.lit(0.0), F.col("shared_end") - F.col("shared_start")))


def low_overlap(times: DataFrame, least: float) -> DataFrame:
    """Streams of which the shared range covers too little; no shared range at all covers 0."""
    both = times.crossJoin(F.broadcast(overlap(times)))  # one row
    ratio = F.when(F.col("duration_sec") <= 0, F.lit(1.0)).otherwise(F.col("overlap_sec") / F.col("duration_sec"))
    ratio = F.when(F.col("shared_start") > F.col("shared_end"), F.lit(0.0)).otherwise(ratio)
    return both.withColumn("overlap_ratio", ratio).where((F.col("streams") >= 2) & (F.col("overlap_ratio") < least))


def pairs(times: DataFrame, name: str) -> DataFrame:
    """Unordered pairs of streams by name: a_*, b_* of a per-stream table."""
    return _paired(times, name)


def start_offsets(times: DataFrame, name: str, threshold: float) -> DataFrame:
    p = pairs(times, name).withColumn("start_offset_sec", F.abs(F.col("a_start_time") - F.col("b_start_time")))
    return p.where(F.col("start_offset_sec") > threshold)


def nearest_gaps(df: DataFrame, name: str, ts: str = "ts", per: float = 1.0, from_left: bool = False, rows_per_slot: int = 250_000) -> DataFrame:
    """(a, b, n, median_gap_sec, max_gap_sec): nearest-time gaps between each pair of streams.

    The shorter stream asks (the first by name if they are equal, or always
    with ``from_left``).  A pair's time range is cut into slots of about
    ``rows_per_slot`` different times, each sorted once forwards and once
    backwards: the nearest target on a side is the last one that a running
    window has seen, or, at a slot's edge, the nearest target of the slots on
    that side.  Equal times of a stream have equal gaps, so they go as one row
    with their number; a long stream's rows meet its pairs in several tasks.
    """
    rows = df.where(F.col(ts).isNotNull()).groupBy(F.col(name).alias("s"), F.col(ts).alias("t")).agg(F.count(F.lit(1)).alias("k"))
    streams = rows.groupBy("s").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("times"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    pair = _paired(streams, "s").select(
        F.col("a_s").alias("a"),
        F.col("b_s").alias("b"),
        (F.lit(True) if from_left else F.col("a_n") <= F.col("b_n")).alias("left"),
        F.ceil((F.col("a_times") + F.col("b_times")) / rows_per_slot).alias("slots"),
        F.least("a_lo", "b_lo").cast("double").alias("lo"),
        F.greatest("a_hi", "b_hi").cast("double").alias("hi"),
    )
    sides = pair.select("*", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("left").alias("asks")), F.struct(F.col("b").alias("s"), (~F.col("left")).alias("asks")))).alias("x")).select("a", "b", "slots", "lo", "hi", "x.*")
    # the slot rises with the time, whatever the rounding
    slot = F.least(F.floor(F.coalesce(F.try_divide(F.col("t") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * F.col("slots")), F.col("slots") - 1)
    rows, sides = _spread(rows, "s", sides, "s", rows_per_slot)
    both = rows.join(sides, ["s", "__salt"]).select("a", "b", slot.alias("slot"), "t", "k", "asks")
    target = F.when(~F.col("asks"), F.col("t"))
    edges = both.groupBy("a", "b", "slot").agg(F.min(target).alias("first"), F.max(target).alias("last"))
    ahead_of, behind = (Window.partitionBy("a", "b").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("slot"), F.col("slot").desc()))
    edges = edges.select("a", "b", "slot", F.max("last").over(ahead_of).alias("carried_back"), F.min("first").over(behind).alias("carried_on"))
    part, seen = Window.partitionBy("a", "b", "slot"), (Window.unboundedPreceding, Window.currentRow)
    before = F.last(target, ignorenulls=True).over(part.orderBy("t", "asks").rowsBetween(*seen))
    after = F.last(target, ignorenulls=True).over(part.orderBy(F.col("t").desc(), "asks").rowsBetween(*seen))
    near = both.select("a", "b", "slot", "t", "k", "asks", before.alias("before"), after.alias("after")).where("asks").join(edges, ["a", "b", "slot"])
    back, on = F.coalesce("before", "carried_back"), F.coalesce("after", "carried_on")
    near = near.select("a", "b", "k", F.least(F.col("t") - back, on - F.col("t")).alias("g")).where("g IS NOT NULL").groupBy("a", "b", "g").agg(F.sum("k").alias("k"))
    return near.groupBy("a", "b").agg(F.sum("k").alias("n"), F.percentile(seconds(F.col("g"), per), 0.5, F.col("k")).alias("median_gap_sec"), F.max(seconds(F.col("g"), per)).alias("max_gap_sec"))


def bursts(df: DataFrame, part: list[str], order: list[str], threshold: float, ts: str = "ts", per: float = 1.0, ranged: bool = True) -> DataFrame:
    """Rows after a long gap in time order, with the samples it swallowed at the stream's median gap."""
    g = gaps(df, part, order, ts, "sorted", per, ranged)
    median = g.groupBy(*part).agg(F.median(_positive()).alias("__median"))
    long = g.where(F.col("gap_sec") > threshold).join(median, part)
    return long.withColumn("estimated_missing_frames", X.missing_count(F.col("gap_sec"), F.col("__median"))).drop("__median")


def jitter(df: DataFrame, part: list[str], ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Population deviation over mean of positive gaps, of streams with three times and two gaps."""
    g = gaps(df, part, [], ts, "sorted", per).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.count(_positive()).alias("k"), F.avg(_positive()).alias("mean"), F.stddev_pop(_positive()).alias("dev"))
    return g.where("n >= 3 AND k >= 2").select(*part, (F.col("dev") / F.col("mean")).alias("jitter_ratio"))


# -- predicates ---------------------------------------------------------------


def not_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) <= 0) for c in columns]))


def out_of_range(df: DataFrame, column: str, low: float, high: float, null_passes: bool = False) -> DataFrame:
    bad = (F.col(column) < low) | (F.col(column) > high)
    return df.where(bad if null_passes else bad | F.col(column).isNull())


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~reduce(lambda a, b: a & b, [X.finite(F.col(c)) for c in columns]))


def outside_span(df: DataFrame, ts: str, others: DataFrame, other_ts: str) -> DataFrame:
    """Rows with a null time or one outside the other table's span; none if that has no time."""
    span = others.agg(F.min(other_ts).alias("span_start"), F.max(other_ts).alias("span_end")).where(F.col("span_start").isNotNull())
    both = df.crossJoin(F.broadcast(span))  # one row
    return both.where(F.col(ts).isNull() | (F.col(ts) < F.col("span_start")) | (F.col(ts) > F.col("span_end")))


def missing_columns(headers: DataFrame, required: Column, columns: str = "columns") -> DataFrame:
    """Rows of a header table that lack required names, with the ``missing`` list."""
    return headers.withColumn("missing", F.array_sort(F.array_except(required, F.col(columns)))).where(F.size("missing") > 0)


# -- tracks -------------------------------------------------------------------


def class_switches(df: DataFrame, part: list[str], order: list[str], cls: str, threshold: int = 0) -> DataFrame:
    """Tracks whose class changes more than ``threshold`` times along the order, with their classes."""
    known = df.where(F.col(cls).isNotNull())
    turned = F.col(cls) != F.lag(cls).over(_window(part, order))
    g = known.withColumn("__t", turned).groupBy(*part).agg(F.count(F.when(F.col("__t"), 1)).alias("class_switches"), F.array_sort(F.collect_set(cls)).alias("classes"))
    return g.where(F.col("class_switches") > threshold)


def box_jumps(df: DataFrame, part: list[str], order: list[str], threshold: float, x="x", y="y", width="width", height="height") -> DataFrame:
    """Rows whose box centre lies far from that of the row before in its track."""
    w = _window(part, order)
    cx, cy = F.col(x) + F.col(width) / 2, F.col(y) + F.col(height) / 2
    known = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (x, y, width, height)]))
    d = known.withColumn("__cx", cx).withColumn("__cy", cy)
    dx, dy = F.col("__cx") - F.lag("__cx").over(w), F.col("__cy") - F.lag("__cy").over(w)
    return d.withColumn("jump_px", F.sqrt(dx * dx + dy * dy)).drop("__cx", "__cy").where(F.col("jump_px") > threshold)


def size_changes(df: DataFrame, part: list[str], order: list[str], threshold: float, width="width", height="height") -> DataFrame:
    w = _window(part, order)
    known = df.where(F.col(width).isNotNull() & F.col(height).isNotNull())
    out = known.withColumn("width_change_ratio", X.symmetric_ratio(F.lag(width).over(w), F.col(width))).withColumn("height_change_ratio", X.symmetric_ratio(F.lag(height).over(w), F.col(height)))
    return out.where((F.col("width_change_ratio") > threshold) | (F.col("height_change_ratio") > threshold))


def missing_labels(df: DataFrame, part: list[str], order: list[str], multiplier: float = 1.5, ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Rows after a gap beyond a multiple of their track's least positive gap, of tracks of three or more rows."""
    g = gaps(df, part, order, ts, "sorted", per, ranged=False)
    whole = Window.partitionBy(*part)
    g = g.withColumn("expected_gap_sec", F.min(_positive()).over(whole)).withColumn("__n", F.count(F.lit(1)).over(whole))
    g = g.where((F.col("__n") >= 3) & (F.col("gap_sec") > F.col("expected_gap_sec") * multiplier)).drop("__n")
    return g.withColumn("estimated_missing_labels", X.missing_count(F.col("gap_sec"), F.col("expected_gap_sec")))


def short_groups(df: DataFrame, part: list[str], least: int) -> DataFrame:
    """Groups of fewer rows than ``least`` (none if that is 1); nulls are a group."""
    return df.groupBy(*part).agg(F.count(F.lit(1)).alias("track_length")).where((F.col("track_length") < least) & F.lit(least > 1))


# -- motion -------------------------------------------------------------------


def speed(vx: str = "vx", vy: str = "vy") -> Column:
    x, y = F.col(vx), F.col(vy)
    return F.when(X.finite(x) & X.finite(y), F.sqrt(x * x + y * y))


def fast_rows(df: DataFrame, limit: float, vx: str = "vx", vy: str = "vy") -> DataFrame:
    return df.withColumn("speed_mps", speed(vx, vy)).where(F.col("speed_mps") > limit)


def accelerations(df: DataFrame, part: list[str], order: list[str], ts: str = "ts", vx: str = "vx", vy: str = "vy", per: float = 1.0) -> DataFrame:
    """Signed change of speed over time to the row before in file order, where time moves forward."""
    w = _window(part, order)
    s = df.withColumn("__v", speed(vx, vy))
    dt = seconds(F.col(ts) - F.lag(ts).over(w), per)
    s = s.withColumn("__dt", dt).withColumn("__dv", F.col("__v") - F.lag("__v").over(w))
    return s.where("__dt > 0").withColumn("acceleration_mps2", F.try_divide(F.col("__dv"), F.col("__dt"))).where("acceleration_mps2 IS NOT NULL").drop("__v", "__dt", "__dv")


def hard_accelerations(df: DataFrame, part: list[str], order: list[str], limit: float, **columns) -> DataFrame:
    return accelerations(df, part, order, **columns).where(F.abs("acceleration_mps2") > limit)


def stationary(df: DataFrame, part: list[str], threshold: float, x: str = "x", y: str = "y") -> DataFrame:
    """Streams whose bounding box has a diagonal of at most ``threshold``."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*part).agg((F.max(x) - F.min(x)).alias("__w"), (F.max(y) - F.min(y)).alias("__h"))
    return g.select(*part, F.sqrt(F.col("__w") * F.col("__w") + F.col("__h") * F.col("__h")).alias("distance_m")).where(F.col("distance_m") <= threshold)


# -- links, groups, comparison -------------------------------------------------


def broken_links(df: DataFrame, key: str, referenced: DataFrame, target: str, guarded: bool = True, rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose key has no match.  Guarded: null or empty keys pass, and so do all if nothing is referenced.

    Rows of a key that more than ``rows`` share, and rows without a key, are looked up in several tasks.
    """
    ref = referenced.select(F.col(target).alias("__ref")).where("__ref IS NOT NULL").distinct()
    if guarded:
        some = ref.limit(1).select(F.lit(1).alias("__some"))
        df = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).crossJoin(F.broadcast(some)).drop("__some")
    columns = df.columns
    df, ref = _spread(df, key, ref, "__ref", rows)
    return df.join(ref, (df[key] == ref["__ref"]) & (df["__salt"] == ref["__salt"]), "left_anti").select(*columns)


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, order: str, columns: list[str]) -> DataFrame:
    """Left lookup in a dimension; of repeated keys the last in ``order`` wins."""
    last = dim.groupBy(F.col(dim_key).alias("__key")).agg(F.max(F.struct(F.col(order).alias("__o"), *columns)).alias("__row"))
    joined = df.join(last, df[key] == last["__key"], "left")
    return joined.select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in columns])


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with ``side``."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(True)), right.select(key).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, key, "full_outer").where("__l IS NULL OR __r IS NULL")
    return both.select(key, F.when(F.col("__l").isNotNull(), "left").otherwise("right").alias("side"))


def repeated_keys(df: DataFrame, key: Column | str, alias: str = "key") -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias(alias)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def numeric_summary(df: DataFrame, column: Column | str) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).alias("median"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def compare_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts of a key in two tables side by side, with what was lost."""
    a, b = value_counts(old, key).withColumnRenamed("n", "old_n"), value_counts(new, key).withColumnRenamed("n", "new_n")
    both = a.join(b, key, "full_outer").select(key, F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))
    return both.withColumn("delta", F.col("new_n") - F.col("old_n")).withColumn("drop_ratio", X.drop_ratio(F.col("old_n"), F.col("new_n")))


def largest_gap(df: DataFrame, part: list[str], ts: str = "ts", per: float = 1.0) -> DataFrame:
    """Per stream the largest gap between distinct sorted times, the first of equals."""
    g = gaps(df.select(*part, ts).distinct(), part, [], ts, "sorted", per).where("gap_sec IS NOT NULL")
    return g.groupBy(*part).agg(F.max(F.struct("gap_sec", (-F.col(ts)).alias("t"))).alias("m")).select(*part, F.col("m.gap_sec").alias("gap_sec"), (-F.col("m.t")).alias(ts))


def first_repeat(df: DataFrame, part: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Per stream: number of surplus equal times, and the first time that repeats."""
    least = F.min(F.struct(*order)) if len(order) > 1 else F.struct(F.min(F.col(order[0]).isNotNull()), F.min(order[0]))  # the second, nulls first too, needs no sort
    times = df.where(F.col(ts).isNotNull()).groupBy(*part, ts).agg(F.count(F.lit(1)).alias("__n"), least.alias("__at")).where("__n > 1")
    return times.groupBy(*part).agg(F.sum(F.col("__n") - 1).alias("surplus"), F.min_by(ts, F.struct("__at", ts)).alias("first_repeat"))


def ordered_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 over the sorted rows of a small table, fields ended by a zero byte."""
    row = F.concat(*[F.concat(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return df.select(row.alias("r"), F.struct(*columns).alias("k")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"])), 256).alias("digest"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's number from 1 in an order of the whole table; no task holds the table.

    Rows are dealt out in ranges and numbered in each.  The last row of a range
    sends the range's size to all later ranges, as one more row for each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy("__range").orderBy(*order)
    d = d.withColumns({"__nth": F.row_number().over(inside).cast("bigint"), "__last": F.lead(F.lit(1)).over(inside).isNull()})
    to = F.when(F.col("__last"), F.sequence(F.col("__range"), F.lit(n - 1))).otherwise(F.array("__range"))
    d = d.select("*", F.explode(to).alias("__to"))
    sent = F.col("__to") != F.col("__range")
    ahead = F.sum(F.when(sent, F.col("__nth")).otherwise(0)).over(Window.partitionBy("__to").orderBy(sent.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn(name, F.col("__nth") + ahead).where(~sent).select(*df.columns, name)
