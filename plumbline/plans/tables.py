"""The rule kernels bound to relational tables, with SQL for each.

A query reads its tables with Spark and applies one kernel; the SQL says the
same for another engine.  Times are whole microseconds until one division, and
averages and roots are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import kernels as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
US = 1e6


def _query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("t", X.micros("ts"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").withColumn("t", X.micros("l_shipdate"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").withColumn("t", X.micros("o_orderdate"))


LINE = ["l_linenumber", "l_partkey", "l_suppkey"]
_EV = "SELECT *, epoch_us(ts) AS t FROM events"
_LI = "SELECT *, epoch_us(l_shipdate) AS t FROM lineitem"
_OR = "SELECT *, epoch_us(o_orderdate) AS t FROM orders"
_LW = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey"


# -- timestamps ---------------------------------------------------------------


@_query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d / 1e6 AS delta_sec FROM
  (SELECT *, t - lag(t) OVER ({_LW}) AS d FROM ({_LI})) WHERE d < 0""")
def monotonic_timestamps(spark, d):
    return K.backward_steps(_lines(spark, d), ["l_orderkey"], LINE, "t", US, ranged=False).select("l_orderkey", *LINE, "delta_sec")


@_query("""SELECT o_custkey, o_orderkey, t FROM
  (SELECT *, epoch_us(o_orderdate) AS t, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1""")
def duplicate_timestamps(spark, d):
    return K.repeated_values(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "t").select("o_custkey", "o_orderkey", "t")


@_query(f"""SELECT event_id, event_type, g / 1e6 AS gap_sec FROM
  (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM ({_EV})) WHERE g / 1e6 > 3600""")
def large_timestamp_gaps(spark, d):
    return K.large_gaps(_events(spark, d), ["event_type"], ["event_id"], 3600, "t", US).select("event_id", "event_type", "gap_sec")


# -- sensors and synchronisation ------------------------------------------------


@_query(f"""SELECT event_type, round(1 / avg(CASE WHEN g > 0 THEN g / 1e6 END), 9) AS observed_hz FROM
  (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM ({_EV})) GROUP BY event_type HAVING count(*) >= 2""")
def sensor_rates(spark, d):
    return K.observed_rates(_events(spark, d), ["event_type"], ["event_id"], "t", US).select("event_type", F.round("observed_hz", 9).alias("observed_hz"))


@_query(f"""SELECT event_type, round(hz, 9) AS observed_hz FROM
  (SELECT event_type, 1 / avg(CASE WHEN g > 0 THEN g / 1e6 END) AS hz FROM
    (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM ({_EV})) GROUP BY event_type HAVING count(*) >= 2)
  WHERE abs(hz - 0.01) / 0.01 > 0.3""")
def sensor_frequency(spark, d):
    e = _events(spark, d)
    rates = e.select("event_type").distinct().withColumn("expected_hz", F.lit(0.01))
    return K.off_rates(e, ["event_type"], ["event_id"], rates, 0.3, "t", US).select("event_type", F.round("observed_hz", 9).alias("observed_hz"))


@_query(f"""WITH g AS (SELECT *, (t - lag(t) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS g FROM ({_EV})),
  m AS (SELECT event_type, median(CASE WHEN g > 0 THEN g END) AS e FROM g GROUP BY event_type HAVING count(*) >= 3)
  SELECT event_id, event_type, g AS gap_sec, e AS expected_gap_sec FROM g JOIN m USING (event_type) WHERE g > e * 8""")
def missing_frames(spark, d):
    return K.missing_frames(_events(spark, d), ["event_type"], ["event_id"], 8, None, "t", US).select("event_id", "event_type", "gap_sec", "expected_gap_sec")


_TIMES = f"""SELECT event_type, min(t) / 1e6 AS start_time, max(t) / 1e6 AS end_time, (max(t) - min(t)) / 1e6 AS duration_sec, count(*) AS frame_count,
  median(CASE WHEN g > 0 THEN g END) AS median_dt_sec, max(CASE WHEN g > 0 THEN g END) AS max_dt_sec, 1 / median(CASE WHEN g > 0 THEN g END) AS inferred_frequency_hz
  FROM (SELECT *, (t - lag(t) OVER (PARTITION BY event_type ORDER BY t)) / 1e6 AS g FROM ({_EV})) GROUP BY event_type"""


@_query(_TIMES)
def sensor_timings(spark, d):
    return K.timings(_events(spark, d), ["event_type"], "t", US)


@_query(f"""WITH t AS ({_TIMES}), o AS (SELECT max(start_time) AS a, min(end_time) AS b, count(*) AS n FROM t)
  SELECT event_type, CASE WHEN a > b THEN 0.0 WHEN duration_sec <= 0 THEN 1.0 ELSE greatest(0.0, b - a) / duration_sec END AS overlap_ratio
  FROM t, o WHERE n >= 2 AND CASE WHEN a > b THEN 0.0 WHEN duration_sec <= 0 THEN 1.0 ELSE greatest(0.0, b - a) / duration_sec END < 0.9999""")
def sensor_time_overlap(spark, d):
    return K.low_overlap(K.timings(_events(spark, d), ["event_type"], "t", US), 0.9999).select("event_type", "overlap_ratio")


@_query(f"""WITH t AS ({_TIMES})
  SELECT x.event_type AS sensor_a, y.event_type AS sensor_b, round(abs(x.start_time - y.start_time), 6) AS start_offset_sec
  FROM t x JOIN t y ON x.event_type < y.event_type WHERE abs(x.start_time - y.start_time) > 60""")
def timestamp_offset(spark, d):
    times = K.timings(_events(spark, d), ["event_type"], "t", US)
    return K.start_offsets(times, "event_type", 60).select(F.col("a_event_type").alias("sensor_a"), F.col("b_event_type").alias("sensor_b"), F.round("start_offset_sec", 6).alias("start_offset_sec"))


_NEAR = """WITH e AS (SELECT event_type AS s, epoch_us(ts) AS t FROM events), c AS (SELECT s, count(*) AS n FROM e GROUP BY s),
  p AS (SELECT x.s AS a, y.s AS b, {source} AS source FROM c x JOIN c y ON x.s < y.s),
  r AS (SELECT a, b, t, CAST(s = source AS INTEGER) AS asks FROM p JOIN e ON e.s = p.a OR e.s = p.b),
  w AS (SELECT *, t - last_value(CASE WHEN asks = 0 THEN t END IGNORE NULLS) OVER (PARTITION BY a, b ORDER BY t, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
    first_value(CASE WHEN asks = 0 THEN t END IGNORE NULLS) OVER (PARTITION BY a, b ORDER BY t, asks ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t AS ahead FROM r)
  SELECT a, b, count(*) AS n, median(least(back, ahead) / 1e6) AS median_gap_sec, max(least(back, ahead) / 1e6) AS max_gap_sec
  FROM w WHERE asks = 1 AND coalesce(back, ahead) IS NOT NULL GROUP BY a, b"""


@_query(_NEAR.format(source="CASE WHEN x.n <= y.n THEN x.s ELSE y.s END"))
def pairwise_sync_gap(spark, d):
    return K.nearest_gaps(_events(spark, d), "event_type", "t", US)


@_query(_NEAR.format(source="x.s"))
def manifest_sync_gap(spark, d):
    return K.nearest_gaps(_events(spark, d), "event_type", "t", US, from_left=True)


@_query(f"""WITH g AS (SELECT *, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 1e6 AS g FROM ({_EV})),
  m AS (SELECT user_id, median(CASE WHEN g > 0 THEN g END) AS e FROM g GROUP BY user_id)
  SELECT event_id, user_id, g AS gap_sec, greatest(1, CAST(round_even(g / e, 0) AS BIGINT) - 1) AS estimated_missing_frames FROM g JOIN m USING (user_id) WHERE g > 150000""")
def missing_frame_bursts(spark, d):
    return K.bursts(_events(spark, d), ["user_id"], ["event_id"], 150000, "t", US, ranged=False).select("event_id", "user_id", "gap_sec", "estimated_missing_frames")


@_query(f"""SELECT event_type, round(stddev_pop(CASE WHEN g > 0 THEN g END) / avg(CASE WHEN g > 0 THEN g END), 6) AS jitter_ratio FROM
  (SELECT *, (t - lag(t) OVER (PARTITION BY event_type ORDER BY t)) / 1e6 AS g FROM ({_EV})) GROUP BY event_type HAVING count(*) >= 3 AND count(CASE WHEN g > 0 THEN 1 END) >= 2""")
def frequency_stability(spark, d):
    return K.jitter(_events(spark, d), ["event_type"], "t", US).select("event_type", F.round("jitter_ratio", 6).alias("jitter_ratio"))


# -- predicates ---------------------------------------------------------------


@_query("SELECT event_id, value FROM events WHERE value IS NULL OR value <= 2")
def sensor_dimensions(spark, d):
    return K.not_positive(_t(spark, d, "events").withColumn("v", F.col("value") - 2), ["v"]).select("event_id", "value")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem WHERE l_discount IS NULL OR l_discount < 0.01 OR l_discount > 0.09")
def confidence_range(spark, d):
    return K.out_of_range(_t(spark, d, "lineitem"), "l_discount", 0.01, 0.09).select("l_orderkey", *LINE, "l_discount")


@_query("SELECT event_id, value FROM events WHERE value < 1.0 OR value > 150.0")
def yaw_range(spark, d):
    return K.out_of_range(_t(spark, d, "events"), "value", 1.0, 150.0, null_passes=True).select("event_id", "value")


@_query("SELECT event_id FROM events WHERE value IS NULL OR isinf(value) OR isnan(value) OR nullif(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 42) IS NULL")
def finite_values(spark, d):
    e = _t(spark, d, "events").withColumn("k", X.num(F.nullif(F.get_json_object("props", "$.k"), F.lit("42")))).withColumn("v", X.num("value"))
    return K.not_finite(e, ["v", "k"]).select("event_id")


@_query("""SELECT o_orderkey FROM orders, (SELECT min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem) WHERE o_orderdate IS NULL OR o_orderdate < a OR o_orderdate > b""")
def label_range(spark, d):
    return K.outside_span(_t(spark, d, "orders"), "o_orderdate", _t(spark, d, "lineitem"), "l_shipdate").select("o_orderkey")


@_query("""SELECT name, missing FROM (VALUES ('events', 'track_id,width'), ('lineitem', 'width')) v(name, missing)""")
def required_columns(spark, d):
    heads = [(n, _t(spark, d, n).columns) for n in ("events", "lineitem", "orders")]
    need = {"events": ["ts", "value", "width", "track_id"], "lineitem": ["l_quantity", "width"], "orders": ["o_orderkey"]}
    h = spark.createDataFrame([(n, c, need[n]) for n, c in heads], "name string, columns array<string>, required array<string>")
    return K.missing_columns(h, F.col("required")).select("name", F.concat_ws(",", "missing").alias("missing"))


# -- tracks -------------------------------------------------------------------


@_query("""WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IS NOT NULL)
  SELECT user_id, count(CASE WHEN event_type <> p THEN 1 END) AS class_switches, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS classes
  FROM s GROUP BY user_id HAVING count(CASE WHEN event_type <> p THEN 1 END) > 50""")
def track_id_consistency(spark, d):
    return K.class_switches(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 50).select("user_id", "class_switches", F.concat_ws(",", "classes").alias("classes"))


@_query("""SELECT conv_id, count(CASE WHEN role <> p THEN 1 END) AS class_switches FROM
  (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role IS NOT NULL) GROUP BY conv_id HAVING count(CASE WHEN role <> p THEN 1 END) > 3""")
def role_switches(spark, d):
    return K.class_switches(_t(spark, d, "conversations"), ["conv_id"], ["turn"], "role", 3).select("conv_id", "class_switches")


_BOX = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(dx * dx + dy * dy), 6) AS jump_px FROM (SELECT *,
  cx - lag(cx) OVER ({_LW}) AS dx, cy - lag(cy) OVER ({_LW}) AS dy FROM (SELECT *, l_quantity + 1.0 / 2 AS cx, l_discount * 100 + 1.0 / 2 AS cy FROM lineitem)) WHERE sqrt(dx * dx + dy * dy) > 30"""


@_query(_BOX)
def bbox_jumps(spark, d):
    b = _t(spark, d, "lineitem").withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount") * 100, "width": F.lit(1.0), "height": F.lit(1.0)})
    return K.box_jumps(b, ["l_orderkey"], LINE, 30).select("l_orderkey", *LINE, F.round("jump_px", 6).alias("jump_px"))


_RATIO = "CASE WHEN {p} <= 0 OR {c} <= 0 THEN 1.0 ELSE greatest({p} / {c}, {c} / {p}) END"
_RW, _RH = _RATIO.format(p="pq", c="l_quantity"), _RATIO.format(p="pp", c="l_extendedprice")


@_query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_RW} AS width_change_ratio, {_RH} AS height_change_ratio FROM
  (SELECT *, lag(l_quantity) OVER ({_LW}) AS pq, lag(l_extendedprice) OVER ({_LW}) AS pp FROM lineitem) WHERE pq IS NOT NULL AND ({_RW} > 3 OR {_RH} > 3)""")
def size_changes(spark, d):
    out = K.size_changes(_t(spark, d, "lineitem"), ["l_orderkey"], LINE, 3, "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", *LINE, "width_change_ratio", "height_change_ratio")


@_query(f"""WITH g AS (SELECT *, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 1e6 AS g, count(*) OVER (PARTITION BY user_id) AS n FROM ({_EV})),
  m AS (SELECT *, min(CASE WHEN g > 0 THEN g END) OVER (PARTITION BY user_id) AS e FROM g)
  SELECT event_id, user_id, g AS gap_sec, e AS expected_gap_sec, greatest(1, CAST(round_even(g / e, 0) AS BIGINT) - 1) AS estimated_missing_labels FROM m WHERE n >= 3 AND g > e * 1.5""")
def label_missing_timestamps(spark, d):
    out = K.missing_labels(_events(spark, d), ["user_id"], ["event_id"], 1.5, "t", US)
    return out.select("event_id", "user_id", "gap_sec", "expected_gap_sec", "estimated_missing_labels")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_shipdate) AS n FROM lineitem) WHERE n > 1""")
def duplicate_track_timestamp(spark, d):
    return K.shared_keys(_t(spark, d, "lineitem"), ["l_orderkey", "l_shipdate"]).select("l_orderkey", *LINE)


@_query("SELECT l_orderkey, count(*) AS track_length FROM lineitem GROUP BY l_orderkey HAVING count(*) < 3")
def short_tracks(spark, d):
    return K.short_groups(_t(spark, d, "lineitem"), ["l_orderkey"], 3)


@_query("SELECT conv_id, count(*) AS track_length FROM conversations GROUP BY conv_id HAVING count(*) < 4")
def short_conversations(spark, d):
    return K.short_groups(_t(spark, d, "conversations"), ["conv_id"], 4)


# -- motion -------------------------------------------------------------------


def _moving(spark, d):
    return _events(spark, d).withColumn("vx", F.col("value")).withColumn("vy", X.num(F.get_json_object("props", "$.k")))


_MV = f"SELECT *, sqrt(value * value + vy * vy) AS v FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vy FROM ({_EV}))"


@_query(f"SELECT event_id, round(v, 6) AS speed_mps FROM ({_MV}) WHERE v > 200")
def unrealistic_speed(spark, d):
    return K.fast_rows(_moving(spark, d), 200).select("event_id", F.round("speed_mps", 6).alias("speed_mps"))


_AC = f"""SELECT *, dv / nullif(dt, 0) AS a FROM (SELECT *, (t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS dt, v - lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS dv FROM ({_MV})) WHERE dt > 0"""


@_query(f"SELECT event_id, user_id, round(a, 6) AS acceleration_mps2 FROM ({_AC}) WHERE abs(a) > 0.02")
def unrealistic_acceleration(spark, d):
    out = K.hard_accelerations(_moving(spark, d), ["user_id"], ["event_id"], 0.02, ts="t", per=US)
    return out.select("event_id", "user_id", F.round("acceleration_mps2", 6).alias("acceleration_mps2"))


@_query("""SELECT user_id, round(sqrt(w * w + h * h), 6) AS distance_m FROM (SELECT user_id, max(value) - min(value) AS w, 0.0 AS h FROM events GROUP BY user_id) WHERE sqrt(w * w + h * h) <= 150""")
def stationary_tracks(spark, d):
    e = _t(spark, d, "events").withColumn("y", F.lit(0.0))
    return K.stationary(e, ["user_id"], 150, "value", "y").select("user_id", F.round("distance_m", 6).alias("distance_m"))


# -- calibration and nested values ----------------------------------------------


@_query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings""")
def quaternion_norm(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(X.norm(F.col("embedding")), 6).alias("norm"))


@_query("""SELECT vec_id, len(embedding) = 64 AS vector_64, len(embedding) = 4 AS vector_4 FROM embeddings""")
def vector_shape(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", X.is_vector(e, 64).alias("vector_64"), X.is_vector(e, 4).alias("vector_4"))


@_query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90""")
def metadata_predicates(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return _t(spark, d, "events").select("event_id", k.alias("k")).where("k >= 90")


# -- joins --------------------------------------------------------------------


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark, d):
    return K.broken_links(_t(spark, d, "documents").select("doc_id"), "doc_id", _t(spark, d, "labels"), "doc_id")


@_query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def broken_links(spark, d):
    return K.broken_links(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", _t(spark, d, "lineitem"), "l_orderkey")


@_query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def framed_sensors(spark, d):
    returned = _t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return _t(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey").distinct()


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def four_way_lookup(spark, d):
    x = K.lookup(_t(spark, d, "lineitem").select("l_orderkey", *LINE), "l_orderkey", _t(spark, d, "orders"), "o_orderkey", "o_orderdate", ["o_custkey"])
    x = K.lookup(x, "o_custkey", _t(spark, d, "customer"), "c_custkey", "c_name", ["c_name", "c_nationkey"])
    x = K.lookup(x, "c_nationkey", _t(spark, d, "nation"), "n_nationkey", "n_name", ["n_name"])
    return x.select("l_orderkey", *LINE, "c_name", "n_name")


@_query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
  FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def one_sided_keys(spark, d):
    return K.one_sided(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@_query("""SELECT s_suppkey, n_name FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) s
  LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) n USING (r)""")
def zip_by_ordinal(spark, d):
    from pyspark.sql import Window

    s = _t(spark, d, "supplier").select("s_suppkey", F.row_number().over(Window.orderBy("s_suppkey")).alias("r"))
    n = _t(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy("n_nationkey")).alias("r"))
    return s.join(n, "r", "left").select("s_suppkey", "n_name")


# -- groups, statistics, comparison ---------------------------------------------


@_query("""SELECT key, count(*) AS n FROM (SELECT regexp_extract(url, '([^/]*)/*$', 1) AS key FROM pages) GROUP BY key HAVING count(*) > 1""")
def duplicate_filenames(spark, d):
    return K.repeated_keys(_t(spark, d, "pages"), X.basename(F.col("url")))


_SUM = "SELECT count({c}) AS \"count\", min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, median({c}) AS median FROM {t}"


def _rounded(df):
    return df.withColumn("mean", F.round("mean", 6))


@_query(_SUM.format(c="value", t="events"))
def numeric_summary(spark, d):
    return _rounded(K.numeric_summary(_t(spark, d, "events"), "value"))


@_query(_SUM.format(c="n", t="(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"))
def track_length_summary(spark, d):
    return _rounded(K.numeric_summary(_t(spark, d, "lineitem").groupBy("l_orderkey").count(), "count"))


@_query(f"SELECT count(a) AS \"count\", round(min(a), 6) AS min, round(max(a), 6) AS max, round(avg(a), 6) AS mean, round(median(a), 6) AS median FROM (SELECT abs(a) AS a FROM ({_AC}))")
def acceleration_summary(spark, d):
    a = K.accelerations(_moving(spark, d), ["user_id"], ["event_id"], ts="t", per=US)
    return K.numeric_summary(a, F.abs("acceleration_mps2")).select("count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median")])


@_query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def class_counts(spark, d):
    return K.value_counts(_t(spark, d, "events"), "event_type")


@_query("""WITH o AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), w AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
  SELECT event_type, coalesce(o.n, 0) AS old_n, coalesce(w.n, 0) AS new_n, coalesce(w.n, 0) - coalesce(o.n, 0) AS delta,
  CASE WHEN coalesce(w.n, 0) < coalesce(o.n, 0) THEN (o.n - coalesce(w.n, 0)) / CAST(o.n AS DOUBLE) ELSE 0.0 END AS drop_ratio FROM o FULL JOIN w USING (event_type)""")
def diff_counts(spark, d):
    e = _t(spark, d, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return K.compare_counts(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "event_type")


@_query(f"""WITH g AS (SELECT event_type, t, (t - lag(t) OVER (PARTITION BY event_type ORDER BY t)) / 1e6 AS g FROM (SELECT DISTINCT event_type, t FROM ({_EV})))
  SELECT event_type, g AS gap_sec, t FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY g DESC, t) AS n FROM g WHERE g IS NOT NULL) WHERE n = 1""")
def largest_gap(spark, d):
    return K.largest_gap(_events(spark, d), ["event_type"], "t", US).select("event_type", "gap_sec", "t")


@_query(f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, t) AS n FROM ({_OR}) WHERE t IS NOT NULL)
  SELECT o_custkey, count(*) - count(DISTINCT t) AS surplus, arg_min(t, o_orderkey) AS first_repeat FROM c WHERE n > 1 GROUP BY o_custkey""")
def first_duplicate(spark, d):
    return K.first_repeat(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "t")


@_query("""SELECT sha256(string_agg(n_name || chr(0) || CAST(length(n_name) AS VARCHAR) || chr(0), '' ORDER BY n_name)) AS digest FROM nation""")
def fingerprint(spark, d):
    return K.ordered_digest(_t(spark, d, "nation").select("n_name", F.length("n_name").alias("size")), ["n_name", "size"])


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def bounded_sample(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1000)


@_query("SELECT doc_id, 'quality' AS name, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def annotations_long(spark, d):
    return _t(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "name", "value")


@_query("SELECT r_regionkey, CAST(unnest(range(r_regionkey, r_regionkey * 3)) AS BIGINT) AS episode FROM region")
def split_ranges(spark, d):
    spec = F.concat(F.col("r_regionkey").cast("string"), F.lit(":"), (F.col("r_regionkey") * 3).cast("string"))
    return _t(spark, d, "region").select("r_regionkey", F.explode(X.range_ids(spec)).alias("episode"))


@_query("""SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name, CASE WHEN contains(lower(url), 'camera') THEN 'camera' WHEN contains(lower(url), 'gps') THEN 'gps' ELSE 'other' END AS kind FROM pages WHERE NOT contains(lower(url), 'lidar') AND NOT contains(lower(url), 'imu')""")
def keyword_typing(spark, d):
    low = F.lower("url")
    return _t(spark, d, "pages").where(~low.contains("lidar") & ~low.contains("imu")).select("page_id", X.basename(F.col("url")).alias("name"), X.sensor_kind(F.col("url")).alias("kind"))


@_query(f"""WITH f AS (SELECT 'check_large_timestamp_gaps' AS check_name, 'warning' AS severity FROM (SELECT *, (t - lag(t) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS g FROM ({_EV})) WHERE g > 3600
  UNION ALL SELECT 'check_unrealistic_speed', 'warning' FROM ({_MV}) WHERE v > 200
  UNION ALL SELECT 'check_yaw_range', 'warning' FROM events WHERE value < 1.0 OR value > 150.0)
  SELECT check_name, CASE WHEN check_name = 'check_unrealistic_speed' THEN 'error' ELSE severity END AS severity, count(*) AS n FROM f GROUP BY ALL""")
def issue_counts(spark, d):
    from plumbline.plans.policy import overridden

    e = _moving(spark, d)
    rows = [(K.large_gaps(e, ["event_type"], ["event_id"], 3600, "t", US), "check_large_timestamp_gaps"), (K.fast_rows(e, 200), "check_unrealistic_speed"), (K.out_of_range(e, "value", 1.0, 150.0, True), "check_yaw_range")]
    found = None
    for df, name in rows:
        one = df.select(F.lit(name).alias("check_name"), F.lit("warning").alias("severity"), F.lit("{}").alias("metadata"))
        found = one if found is None else found.unionByName(one)
    return overridden(found, {"check_unrealistic_speed": "error"}).groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
