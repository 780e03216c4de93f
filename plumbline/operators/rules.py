"""Rules over manifests: each gives rows (rule, kind, message, ord)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import kernels as K
from plumbline.sources.manifest import Manifest

#: Fixed values of the rules.
SYNC_SEC, EPSILON, LARGE_GAP_SEC = 0.05, 1e-6, 1.0
NEED_CALIBRATION = ("kitti", "argoverse2", "nuscenes", "waymo")
LINK_ANNOTATIONS = ("coco", "kitti", "generic", "nuscenes", "huggingface")


def told(df: DataFrame, rule: str, kind: str, *message: Column | str, order: Column | None = None) -> DataFrame:
    text = F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in message])
    return df.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), text.alias("message"), (order if order is not None else F.lit(0)).cast("bigint").alias("ord"))


def _semantic(m: Manifest) -> tuple[DataFrame, DataFrame]:
    """Frames and sensors without placeholders of an index."""
    keep = lambda df: df.where(~F.coalesce(F.get_json_object("metadata", "$.indexed_tfrecord") == "true", F.lit(False)))
    return keep(m.frames), keep(m.sensors)


def frame_references(m: Manifest, index: DataFrame) -> list[DataFrame]:
    frames, _ = _semantic(m)
    twice = K.repeated_keys(frames, "frame_id")
    lost = K.broken_links(frames, "sequence_id", m.sequences, "sequence_id")
    local = frames.where(F.col("file_path").isNotNull() & (F.col("file_path") != "") & ~F.col("file_path").rlike("^([a-z0-9+]+://|/)"))
    gone = K.broken_links(local, "file_path", index, "rel_path", guarded=False)
    return [
        told(twice, "frame_references", "error", "frame id occurs more than once: ", F.col("key")),
        told(lost, "frame_references", "error", "frame ", F.col("frame_id"), " names an unknown sequence: ", F.col("sequence_id"), order=F.col("ord")),
        told(gone, "frame_references", "error", "frame ", F.col("frame_id"), " names a missing file: ", F.col("file_path"), order=F.col("ord")),
    ]


def sensor_links(m: Manifest) -> list[DataFrame]:
    frames, sensors = _semantic(m)
    lost = K.broken_links(frames, "sensor_id", sensors, "sensor_id").groupBy("sensor_id").agg(F.min("ord").alias("ord"))
    seen = frames.where("sensor_id IS NOT NULL").groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))
    both = sensors.join(seen, "sensor_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = frames.limit(1).select(F.lit(1).alias("__some"))
    idle = both.where("n = 0").crossJoin(F.broadcast(some))
    off = both.where("frame_count IS NOT NULL AND frame_count <> n AND n > 0")
    return [
        told(lost, "sensor_links", "error", "frames name an unknown sensor: ", F.col("sensor_id"), order=F.col("ord")),
        told(idle, "sensor_links", "warning", "sensor has no frames: ", F.col("sensor_id"), order=F.col("ord")),
        told(off, "sensor_links", "warning", "sensor ", F.col("sensor_id"), " declares ", F.col("frame_count"), " frames, the manifest has ", F.col("n"), order=F.col("ord")),
    ]


def _timed(m: Manifest) -> DataFrame:
    frames, _ = _semantic(m)
    return frames.where("timestamp IS NOT NULL").select(F.coalesce("sensor_id", F.lit("unknown")).alias("sensor_id"), F.col("timestamp").alias("ts"), "ord")


def timestamps(m: Manifest) -> list[DataFrame]:
    t = _timed(m)
    part = ["sensor_id"]
    again = K.first_repeat(t, part, ["ord"]).where("surplus > 0")
    back = K.backward_steps(t, part, ["ord"]).groupBy(*part).agg(F.min(F.struct("ord", "ts")).alias("__at")).select(*part, "__at.ts")
    wide = K.largest_gap(t, part).where(F.col("gap_sec") > LARGE_GAP_SEC)
    return [
        told(again, "timestamps", "warning", "sensor ", F.col("sensor_id"), ": ", F.col("surplus"), " repeated timestamps, first ", F.col("first_repeat")),
        told(back, "timestamps", "error", "sensor ", F.col("sensor_id"), ": timestamps decrease at ", F.col("ts")),
        told(wide, "timestamps", "warning", "sensor ", F.col("sensor_id"), ": gap of ", F.round("gap_sec", 3), " s"),
    ]


def timestamp_stats(m: Manifest) -> DataFrame:
    return _timed(m).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("min"), F.max("ts").alias("max"))


def sync_stats(m: Manifest) -> DataFrame:
    """Per pair of sensors: whether their ranges are disjoint, and nearest gaps asked from the first."""
    t = _timed(m)
    p = K.pairs(t.groupBy("sensor_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time")), "sensor_id")
    near = K.nearest_gaps(t, "sensor_id", from_left=True)
    out = p.join(near, (F.col("a") == F.col("a_sensor_id")) & (F.col("b") == F.col("b_sensor_id")))
    apart = (F.col("a_end_time") < F.col("b_start_time")) | (F.col("b_end_time") < F.col("a_start_time"))
    return out.select("a", "b", apart.alias("disjoint"), "median_gap_sec", "max_gap_sec")


def sync(m: Manifest) -> list[DataFrame]:
    s = sync_stats(m)
    wide = s.where(~F.col("disjoint") & (F.col("median_gap_sec") - SYNC_SEC > EPSILON))
    return [
        told(s.where("disjoint"), "sync", "warning", "time ranges of ", F.col("a"), " and ", F.col("b"), " don't meet"),
        told(wide, "sync", "warning", "median gap between ", F.col("a"), " and ", F.col("b"), ": ", F.round("median_gap_sec", 3), " s"),
    ]


def annotations(m: Manifest) -> list[DataFrame]:
    a = m.annotations
    out = [told(K.repeated_keys(a, "annotation_id"), "annotations", "error", "annotation id occurs more than once: ", F.col("key"))]
    if m.adapter_name in LINK_ANNOTATIONS:
        out.append(told(K.broken_links(a, "frame_id", m.frames, "frame_id"), "annotations", "error", "annotation ", F.col("annotation_id"), " names an unknown frame: ", F.col("frame_id"), order=F.col("ord")))
    lost = K.broken_links(a, "sequence_id", m.sequences, "sequence_id")
    return [*out, told(lost, "annotations", "error", "annotation ", F.col("annotation_id"), " names an unknown sequence: ", F.col("sequence_id"), order=F.col("ord"))]


def calibration(m: Manifest) -> list[DataFrame]:
    c = m.calibration
    bad = c.where(F.col("intrinsic").isNotNull() & ~X.is_matrix(F.col("intrinsic"), 3, 3))
    out = [told(bad, "calibration", "error", "intrinsic of ", F.col("sensor_id"), " isn't a 3x3 matrix", order=F.col("ord"))]
    if m.adapter_name in NEED_CALIBRATION:
        have = c.select(F.explode(F.array("sensor_id", "target_sensor_id")).alias("s")).where("s IS NOT NULL")
        need = m.sensors.where(F.col("sensor_type").isin("camera", "lidar")).join(m.frames.select("sensor_id").distinct(), "sensor_id", "left_semi")
        lost = K.broken_links(need, "sensor_id", have, "s", guarded=False)
        out.append(told(lost, "calibration", "warning", "sensor has no calibration: ", F.col("sensor_id"), order=F.col("ord")))
    return out


def splits(m: Manifest) -> list[DataFrame]:
    lost = K.broken_links(m.splits, "frame_id", m.frames, "frame_id")
    grouped = lost.groupBy("split").agg(F.concat_ws(", ", F.array_sort(F.collect_set("frame_id"))).alias("ids"))
    return [told(grouped, "splits", "error", "split ", F.col("split"), " names unknown frames: ", F.col("ids"))]


def run_rules(m: Manifest, index: DataFrame) -> DataFrame:
    """All rules of a manifest as one DataFrame, each message once."""
    parts = [frame_references(m, index), sensor_links(m), timestamps(m), sync(m), annotations(m), calibration(m), splits(m)]
    found = [df.withColumn("place", F.lit(i)) for i, df in enumerate(df for p in parts for df in p)]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("kind", "message").agg(F.min(F.struct("place", "ord", "rule")).alias("k")).select("k.rule", "kind", "message", "k.place", "k.ord").orderBy("place", "ord", "message")
