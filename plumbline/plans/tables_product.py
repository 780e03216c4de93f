"""Whole rules, checks and statistics bound to relational tables, with SQL for each.

Unlike :mod:`plumbline.plans.tables`, which binds kernels, these queries put the
tables into a manifest or a folder bundle and run what a user runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import LintConfig
from plumbline.functions import exprs as X
from plumbline.operators import kernels as K
from plumbline.operators import rules
from plumbline.plans.diff import DatasetDiffReport, compare_stats
from plumbline.plans.lint import ORDER, run_checks
from plumbline.plans.stats import DatasetStats, bundle_stats
from plumbline.plans.tables import _query, _t
from plumbline.sources.bundle import Bundle
from plumbline.sources.manifest import Manifest, make_manifest

# -- a manifest of orders: lines are frames and annotations, parts are files -----


def _text(c: str):
    return F.col(c).cast("string")


def _manifest(spark: SparkSession, d: str, adapter: str = "nuscenes") -> Manifest:
    lines, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    key = F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"))
    place = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    frames = lines.select(
        key.alias("frame_id"), F.col("l_linestatus").alias("sequence_id"), (X.micros("l_shipdate") / 1e6).alias("timestamp"), F.col("l_returnflag").alias("sensor_id"),
        F.concat(F.lit("parts/"), _text("l_partkey"), F.lit(".bin")).alias("file_path"), place.alias("ord"),
    )
    e = F.col("embedding")
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice(e, 3 * i + 1, F.when(F.col("label") < 5, F.lit(3)).otherwise(F.lit(2))))
    tables = {
        "frames": frames,
        "sequences": orders.where("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("sequence_id")).distinct(),
        "sensors": _t(spark, d, "region").select(F.substring("r_name", 1, 1).alias("sensor_id"), F.lit("camera").alias("sensor_type"), F.lit(7).alias("frame_count"), F.col("r_regionkey").alias("ord")).dropDuplicates(["sensor_id"]),
        "annotations": orders.select(_text("o_custkey").alias("annotation_id"), F.concat_ws("-", _text("o_orderkey"), F.lit("6")).alias("frame_id"), F.col("o_orderstatus").alias("sequence_id"), F.col("o_orderkey").alias("ord")),
        "calibration": _t(spark, d, "embeddings").select(_text("vec_id").alias("sensor_id"), rows.cast("array<array<double>>").alias("intrinsic"), F.col("vec_id").alias("ord")),
        "splits": _t(spark, d, "customer").select(F.col("c_mktsegment").alias("split"), F.concat_ws("-", _text("c_custkey"), F.lit("1")).alias("frame_id"), F.col("c_custkey").alias("ord")),
    }
    return make_manifest(spark, "orders", adapter, "", tables)


def _found(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select("rule", "kind", "message")


_FRAMES = "f AS (SELECT l_orderkey || '-' || l_linenumber AS frame_id, l_linestatus AS sequence_id, l_returnflag AS sensor_id, 'parts/' || l_partkey || '.bin' AS file_path, epoch_us(l_shipdate) AS t, l_orderkey * 100 + l_linenumber AS ord FROM lineitem)"
_SEQS = "s AS (SELECT DISTINCT o_orderstatus AS sequence_id FROM orders WHERE o_orderstatus <> 'P')"
_SENSORS = "n AS (SELECT DISTINCT substr(r_name, 1, 1) AS sensor_id FROM region)"


@_query(f"""WITH {_FRAMES}, {_SEQS}
  SELECT 'frame_references' AS rule, 'error' AS kind, 'frame id occurs more than once: ' || frame_id AS message FROM f GROUP BY frame_id HAVING count(*) > 1
  UNION ALL SELECT 'frame_references', 'error', 'frame ' || frame_id || ' names an unknown sequence: ' || sequence_id FROM f WHERE sequence_id <> '' AND EXISTS (SELECT 1 FROM s) AND sequence_id NOT IN (SELECT sequence_id FROM s)
  UNION ALL SELECT 'frame_references', 'error', 'frame ' || frame_id || ' names a missing file: ' || file_path FROM f WHERE file_path NOT IN (SELECT 'parts/' || p_partkey || '.bin' FROM part WHERE p_size < 45)""")
def rule_frame_references(spark, d):
    index = _t(spark, d, "part").where("p_size < 45").select(F.concat(F.lit("parts/"), _text("p_partkey"), F.lit(".bin")).alias("rel_path"))
    return _found(rules.frame_references(_manifest(spark, d), index))


@_query(f"""WITH {_FRAMES}, {_SENSORS}, c AS (SELECT sensor_id, count(*) AS n FROM f GROUP BY sensor_id)
  SELECT 'sensor_links' AS rule, 'error' AS kind, 'frames name an unknown sensor: ' || sensor_id AS message FROM c WHERE sensor_id NOT IN (SELECT sensor_id FROM n)
  UNION ALL SELECT 'sensor_links', 'warning', 'sensor has no frames: ' || sensor_id FROM n WHERE sensor_id NOT IN (SELECT sensor_id FROM c)
  UNION ALL SELECT 'sensor_links', 'warning', 'sensor ' || sensor_id || ' declares 7 frames, the manifest has ' || c.n FROM n JOIN c USING (sensor_id) WHERE c.n <> 7""")
def rule_sensor_links(spark, d):
    return _found(rules.sensor_links(_manifest(spark, d)))


@_query(f"""WITH {_FRAMES}, {_SEQS}
  SELECT 'annotations' AS rule, 'error' AS kind, 'annotation id occurs more than once: ' || o_custkey AS message FROM orders GROUP BY o_custkey HAVING count(*) > 1
  UNION ALL SELECT 'annotations', 'error', 'annotation ' || o_custkey || ' names an unknown frame: ' || o_orderkey || '-6' FROM orders WHERE o_orderkey || '-6' NOT IN (SELECT frame_id FROM f)
  UNION ALL SELECT 'annotations', 'error', 'annotation ' || o_custkey || ' names an unknown sequence: ' || o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM s) AND o_orderstatus NOT IN (SELECT sequence_id FROM s)""")
def rule_annotations(spark, d):
    return _found(rules.annotations(_manifest(spark, d)))


@_query(f"""WITH {_FRAMES}, {_SENSORS}
  SELECT 'calibration' AS rule, 'error' AS kind, 'intrinsic of ' || vec_id || ' isn''t a 3x3 matrix' AS message FROM embeddings WHERE label >= 5
  UNION ALL SELECT 'calibration', 'warning', 'sensor has no calibration: ' || sensor_id FROM n WHERE sensor_id IN (SELECT sensor_id FROM f)""")
def rule_calibration(spark, d):
    return _found(rules.calibration(_manifest(spark, d)))


@_query(f"""WITH {_FRAMES}
  SELECT 'splits' AS rule, 'error' AS kind, 'split ' || c_mktsegment || ' names unknown frames: ' || string_agg(DISTINCT c_custkey || '-1', ', ' ORDER BY c_custkey || '-1') AS message
  FROM customer WHERE c_custkey || '-1' NOT IN (SELECT frame_id FROM f) GROUP BY c_mktsegment""")
def rule_splits(spark, d):
    return _found(rules.splits(_manifest(spark, d)))


@_query(f"""WITH {_FRAMES}, g AS (SELECT sensor_id, t - lag(t) OVER (PARTITION BY sensor_id ORDER BY ord) AS d FROM f),
  u AS (SELECT sensor_id, t - lag(t) OVER (PARTITION BY sensor_id ORDER BY t) AS d FROM (SELECT DISTINCT sensor_id, t FROM f))
  SELECT 'error' AS kind, 'sensor ' || sensor_id || ': timestamps decrease at' AS head FROM g WHERE d < 0 GROUP BY sensor_id
  UNION ALL SELECT 'warning', 'sensor ' || sensor_id || ': ' || (count(*) - count(DISTINCT t)) || ' repeated timestamps, first' FROM f JOIN (SELECT sensor_id, t FROM f GROUP BY sensor_id, t HAVING count(*) > 1) USING (sensor_id, t) GROUP BY sensor_id
  UNION ALL SELECT 'warning', 'sensor ' || sensor_id || ': gap of' FROM u GROUP BY sensor_id HAVING max(d) > 1000000""")
def rule_timestamps(spark, d):
    found = _found(rules.timestamps(_manifest(spark, d)))
    return found.select("kind", F.regexp_extract("message", "^(.*?( at| first| of)) ", 1).alias("head"))


@_query(f"""WITH {_FRAMES} SELECT sensor_id, count(*) AS count, min(t) / 1e6 AS min, max(t) / 1e6 AS max FROM f GROUP BY sensor_id""")
def manifest_timestamp_stats(spark, d):
    return rules.timestamp_stats(_manifest(spark, d))


@_query(f"""WITH {_FRAMES}, r AS (SELECT sensor_id AS s, min(t) AS lo, max(t) AS hi FROM f GROUP BY sensor_id)
  SELECT x.s AS a, y.s AS b, x.hi < y.lo OR y.hi < x.lo AS disjoint FROM r x JOIN r y ON x.s < y.s""")
def manifest_sync_pairs(spark, d):
    return rules.sync_stats(_manifest(spark, d)).select("a", "b", "disjoint")


@_query("""SELECT 'sequences' AS name, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'frames', count(*) FROM lineitem
  UNION ALL SELECT 'sensors', count(DISTINCT substr(r_name, 1, 1)) FROM region UNION ALL SELECT 'annotations', count(*) FROM orders
  UNION ALL SELECT 'calibration', count(*) FROM embeddings UNION ALL SELECT 'splits', count(*) FROM customer""")
def manifest_counts(spark, d):
    return spark.createDataFrame([*_manifest(spark, d).counts().items()], "name string, n bigint")


@_query(f"WITH {_FRAMES} SELECT frame_id, sensor_id, file_path FROM f WHERE sequence_id = 'O'")
def frames_of_a_sequence(spark, d):
    return _manifest(spark, d).iter_frames("O").select("frame_id", "sensor_id", "file_path")


@_query("SELECT o_custkey || '' AS annotation_id, o_orderkey || '-6' AS frame_id FROM orders WHERE o_orderstatus = 'F'")
def annotations_of_a_sequence(spark, d):
    return _manifest(spark, d).iter_annotations("F").select("annotation_id", "frame_id")


@_query(f"WITH {_FRAMES} SELECT t / 1e6 AS timestamp FROM f WHERE sensor_id = 'R'")
def timestamps_of_a_sensor(spark, d):
    return _manifest(spark, d).timestamps("R")


# -- a folder bundle of events, its documents made of the nations ----------------

_EVENT_FILES = "sensors/"


def _bundle(spark: SparkSession, d: str, old: bool | None = None) -> Bundle:
    """Events as sensor streams, user rows as labels; ``old`` takes the time before or after 16 January."""
    e = _t(spark, d, "events")
    if old is not None:
        cut = F.lit("2024-01-16").cast("timestamp_ntz")
        e = e.where(F.col("ts") < cut if old else F.col("ts") >= cut)
    file = F.concat(F.lit(_EVENT_FILES), F.col("event_type"), F.lit(".csv"))
    streams = e.select(F.col("event_type").alias("stream"), file.alias("file"), F.col("event_id").cast("int").alias("row"), (X.micros("ts") / 1e6).alias("ts"), F.lit("").alias("timestamp"))
    labels = e.select(F.lit("labels/users.csv").alias("file"), F.lit("users").alias("stream"), F.col("event_id").cast("int").alias("row"), (X.micros("ts") / 1e6).alias("ts"), F.col("event_type").alias("class"), _text("user_id").alias("track_id"), (F.col("value") / 100).cast("string").alias("confidence"))
    nations = [(r.n_nationkey, r.n_name) for r in _t(spark, d, "nation").orderBy("n_nationkey").collect()]
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect())
    b = Bundle(spark, None, LintConfig())
    b.metadata = {"dataset_name": "", "sensors": [*kinds, *(n for _, n in nations)], "duration_sec": 60.0}
    b.calibration = {n: _calibrated(k) for k, n in nations}
    b.headers = {"sensors": {f"{_EVENT_FILES}{k}.csv": ["timestamp"] for k in kinds} | {f"sensors/camera_{k}.csv": ["timestamp", "path", "width", "height"][: k % 5] for k, _ in nations}, "labels": {"labels/users.csv": ["timestamp", "class", "track_id", "confidence"]}, "trajectories": {}}
    b.all_files = {m: [*h] for m, h in b.headers.items()}
    b.frames = {"sensors": streams, "labels": labels, "trajectories": None}
    b.store = type("Nowhere", (), {"root": d, "files": []})()
    return b


def _calibrated(k: int) -> dict:
    lens = [[k - 3, 0, 1], [0, 5, 1], [0, 0, 1]] if k % 3 else [[1, 2]]
    turn = [k / 24, 0, 0, 1] if k % 4 else [1, 0]
    return {"intrinsics": lens, "extrinsics": {"translation": [0, 0, k], "rotation_quat": turn}} if k % 7 else {}


def _told(spark, d, *names: str) -> DataFrame:
    checks = [f"check_{n}" for n in names]
    return run_checks(_bundle(spark, d), checks).select("check_name", "severity", "file", F.get_json_object("metadata", "$.sensor").alias("sensor"))


@_query("""SELECT 'check_metadata_schema' AS check_name, 'error' AS severity, 'metadata.json' AS file, CAST(NULL AS VARCHAR) AS sensor
  UNION ALL SELECT 'check_dataset_version_present', 'warning', 'metadata.json', NULL
  UNION ALL SELECT 'check_duration_matches_timestamps', 'warning', 'metadata.json', NULL FROM events HAVING abs(60 - (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) > 1
  UNION ALL SELECT 'check_declared_sensors_exist', 'error', 'metadata.json', n_name FROM nation
  UNION ALL SELECT 'check_missing_sensor_files', 'error', 'sensors/' || n_name || '.csv', n_name FROM nation
  UNION ALL SELECT 'check_required_files', 'error', unnest(['metadata.json', 'calibration.json']), NULL""")
def folder_metadata_checks(spark, d):
    return _told(spark, d, "metadata_schema", "dataset_version_present", "duration_matches_timestamps", "declared_sensors_exist", "missing_sensor_files", "required_files")


_CAL = "c AS (SELECT n_nationkey AS k, n_name AS s FROM nation)"


@_query(f"""WITH {_CAL}
  SELECT 'check_calibration_exists' AS check_name, 'error' AS severity, 'calibration.json' AS file, event_type AS sensor FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT 'check_intrinsics_shape', 'error', 'calibration.json', s FROM c WHERE k % 7 <> 0 AND k % 3 = 0
  UNION ALL SELECT 'check_intrinsics_values', 'error', 'calibration.json', s FROM c WHERE k % 7 <> 0 AND k % 3 <> 0 AND k <= 3
  UNION ALL SELECT 'check_extrinsics_shape', 'error', 'calibration.json', s FROM c WHERE k % 7 = 0 OR k % 4 = 0
  UNION ALL SELECT 'check_quaternion_norm', 'error', 'calibration.json', s FROM c WHERE k % 7 <> 0 AND k % 4 <> 0 AND abs(sqrt(k * k / 576.0 + 1) - 1) > greatest(0.01 * greatest(sqrt(k * k / 576.0 + 1), 1), 0.01)""")
def folder_calibration_checks(spark, d):
    return _told(spark, d, "calibration_exists", "intrinsics_shape", "intrinsics_values", "extrinsics_shape", "quaternion_norm")


@_query("""SELECT 'check_sensor_columns' AS check_name, 'error' AS severity, 'sensors/camera_' || n_nationkey || '.csv' AS file, 'camera_' || n_nationkey AS sensor FROM nation WHERE n_nationkey % 5 < 4
  UNION ALL SELECT 'check_label_columns', 'error', 'labels/users.csv', NULL""")
def folder_column_checks(spark, d):
    return _told(spark, d, "sensor_columns", "label_columns", "trajectory_columns")


@_query("""WITH g AS (SELECT event_id, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS g FROM events),
  u AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id)) / 1e6 AS g FROM events),
  found AS (SELECT 0 AS place, '0sensors/' || event_type || '.csv' AS k, event_id, 'sensors/' || event_type || '.csv' AS file FROM g WHERE g > 0.5
    UNION ALL SELECT 0, '2labels/users.csv', event_id, 'labels/users.csv' FROM u WHERE g > 0.5
    UNION ALL SELECT 1, 'labels/users.csv', event_id, 'labels/users.csv' FROM events WHERE value / 100 < 0 OR value / 100 > 1)
  SELECT row_number() OVER (ORDER BY place, k, event_id) AS nth, file, CAST(event_id AS INTEGER) AS row FROM found""")
def findings_in_order(spark, d):
    found = run_checks(_bundle(spark, d), ["check_large_timestamp_gaps", "check_label_confidence_range"])
    return K.numbered(found.select(*ORDER, "file", "row"), ORDER, "nth").select("nth", "file", "row")


def _listed(spark: SparkSession, s: DatasetStats) -> DataFrame:
    rows = [("duration_sec", "", s.duration_sec), *(("frames", k, float(v)) for k, v in s.frame_counts.items()), *(("missing", k, float(v)) for k, v in s.missing_frame_counts.items()), *(("classes", k, float(v)) for k, v in s.label_class_counts.items())]
    rows += [(f"{n}_{x}", "", float(v)) for n in ("confidence", "track_length") for x in ("count", "min", "max", "median") if (v := getattr(getattr(s, f"{n}_summary"), x)) is not None]
    return spark.createDataFrame(rows, "name string, key string, value double").withColumn("value", F.round("value", 6))


@_query("""WITH g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6 AS g FROM events), k AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
  SELECT name, key, round(value, 6) AS value FROM (SELECT 'duration_sec' AS name, '' AS key, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS value FROM events
  UNION ALL SELECT 'frames', event_type, count(*) FROM events GROUP BY event_type UNION ALL SELECT 'frames', 'camera_' || n_nationkey, 0 FROM nation
  UNION ALL SELECT 'missing', event_type, count(*) FILTER (WHERE g > 0.5) FROM g GROUP BY event_type
  UNION ALL SELECT 'classes', event_type, count(*) FROM events GROUP BY event_type
  UNION ALL SELECT 'confidence_' || x.n, '', x.v FROM (SELECT unnest([{'n': 'count', 'v': CAST(count(value) AS DOUBLE)}, {'n': 'min', 'v': min(value / 100)}, {'n': 'max', 'v': max(value / 100)}, {'n': 'median', 'v': median(value / 100)}]) AS x FROM events)
  UNION ALL SELECT 'track_length_' || x.n, '', x.v FROM (SELECT unnest([{'n': 'count', 'v': CAST(count(n) AS DOUBLE)}, {'n': 'min', 'v': min(n)}, {'n': 'max', 'v': max(n)}, {'n': 'median', 'v': median(n)}]) AS x FROM k))""")
def folder_statistics(spark, d):
    return _listed(spark, bundle_stats(_bundle(spark, d), []))


@_query("""WITH o AS (SELECT event_type AS k, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), w AS (SELECT event_type AS k, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
  b AS (SELECT k, coalesce(o.n, 0) AS x, coalesce(w.n, 0) AS y FROM o FULL JOIN w USING (k))
  SELECT 'frame_counts' AS category, k AS name, y - x AS delta, CASE WHEN y < x AND (x - y) / CAST(x AS DOUBLE) > 0.1 THEN 'warning' ELSE 'info' END AS severity FROM b WHERE x <> y
  UNION ALL SELECT 'label_classes', k, y - x, CASE WHEN y = 0 THEN 'warning' ELSE 'info' END FROM b WHERE x <> y
  UNION ALL SELECT 'issues', 'warning', 2, 'warning'""")
def folder_comparison(spark, d):
    config, report = LintConfig(), DatasetDiffReport("old", "new")
    old, new = (bundle_stats(_bundle(spark, d, x), []) for x in (True, False))
    new.issue_summary = {"warning": 2}
    compare_stats(report, old, new, config, {}, ({}, {}))
    rows = [(c.category, c.name, int(c.delta), c.severity) for c in report.changes if c.category in ("frame_counts", "label_classes", "issues")]
    return spark.createDataFrame(rows, "category string, name string, delta bigint, severity string")


# -- scalars that the adapters use ------------------------------------------------


@_query("""SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name, CASE WHEN regexp_matches(lower(url), 'image|camera') THEN 'camera' WHEN regexp_matches(lower(url), 'lidar|pointcloud|points') THEN 'lidar' WHEN regexp_matches(lower(url), 'imu') THEN 'imu' WHEN regexp_matches(lower(url), 'gps|navsat|gnss') THEN 'gps' ELSE 'topic' END AS kind FROM pages""")
def topic_typing(spark, d):
    return _t(spark, d, "pages").select("page_id", X.basename(F.col("url")).alias("name"), X.topic_kind(F.col("url"), F.lit(None).cast("string")).alias("kind"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT (l_quantity - 25 > 0 AND l_tax > 0)")
def boxes_without_area(spark, d):
    box = F.array(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity") - 25, F.col("l_tax"))
    flat = (F.try_element_at(box, F.lit(3)) <= 0) | (F.try_element_at(box, F.lit(4)) <= 0)
    return _t(spark, d, "lineitem").where(flat).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("""SELECT vec_id, CAST(label < 5 AS BOOLEAN) AS matrix_3x3, label < 5 AS first_row_of_3 FROM embeddings""")
def matrix_shape(spark, d):
    m = _manifest(spark, d).calibration
    good = X.is_matrix(F.col("intrinsic"), 3, 3)
    return m.select(F.col("sensor_id").cast("bigint").alias("vec_id"), good.alias("matrix_3x3"), X.is_vector(F.get("intrinsic", 0), 3).alias("first_row_of_3"))
