"""The 42 checks of a native dataset folder, in order of registration.

A check takes a :class:`Bundle` and gives findings: DataFrames for rules over
rows, plain dicts for rules over the two small JSON documents and the list of
files.  Names, severities and metadata keys are the interface; messages are
``<what> Location: <file[:row]>. Fix: <advice>``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import kernels as K
from plumbline.sources.bundle import Bundle

#: check_name, severity, message, file, row, metadata and the place in the report
FINDING = "check_name string, severity string, message string, file string, row int, metadata string, place int, k_text string, k_num double, k_row int"
LABEL_COLUMNS = ("timestamp", "track_id", "class", "x", "y", "width", "height", "confidence")
TRAJECTORY_COLUMNS = ("timestamp", "x", "y", "yaw", "vx", "vy")
SENSOR_COLUMNS = {
    "camera": ("timestamp", "path", "width", "height"),
    "imu": ("timestamp", "ax", "ay", "az", "gx", "gy", "gz"),
    "gps": ("timestamp", "lat", "lon", "alt"),
    "": ("timestamp",),
}


@dataclass(frozen=True)
class Check:
    name: str
    group: str
    severity: str
    message: str
    advice: str
    run: Callable[[Bundle, Check], list]


CHECKS: dict[str, Check] = {}


def check(group: str, severity: str, message: str, advice: str):
    def keep(f):
        CHECKS[f.__name__] = Check(f.__name__, group, severity, message, advice, f)
        return f

    return keep


def place(message: Column | str, advice: str, file: Column | None, row: Column | None) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    if file is None:
        return F.concat(m, F.lit(f" Fix: {advice}"))
    at = file if row is None else F.concat(file, F.lit(":"), row.cast("string"))
    return F.concat(m, F.lit(" Location: "), at, F.lit(f". Fix: {advice}"))


def findings(df: DataFrame, c: Check, meta: dict[str, Column], file: str | None = "file", row: str | None = "row", text: str | Column | None = "file", num: Column | None = None, message: Column | str | None = None, severity: str | None = None) -> DataFrame:
    """Rows of ``df`` as findings of a check."""
    f, r = (F.col(file) if file else None), (F.col(row) if row else None)
    values = F.struct(*[v.alias(k) for k, v in {**meta, "suggestion": F.lit(c.advice)}.items()])
    key = F.lit("") if text is None else F.col(text) if isinstance(text, str) else text
    return df.select(
        F.lit(c.name).alias("check_name"),
        F.lit(severity or c.severity).alias("severity"),
        place(message if message is not None else c.message, c.advice, f, r).alias("message"),
        (f if f is not None else F.lit(None).cast("string")).alias("file"),
        (r if r is not None else F.lit(None)).cast("int").alias("row"),
        F.to_json(values, {"ignoreNullFields": "false"}).alias("metadata"),
        F.lit(0).alias("place"),
        key.alias("k_text"),
        (num if num is not None else F.lit(0.0)).cast("double").alias("k_num"),
        (r if r is not None else F.lit(0)).cast("int").alias("k_row"),
    )


def plain(c: Check, file: str | None = None, message: str | None = None, **meta) -> dict:
    at = f" Location: {file}." if file else ""
    return {"check_name": c.name, "severity": c.severity, "message": f"{message or c.message}{at} Fix: {c.advice}", "file": file, "row": None, "metadata": {**meta, "suggestion": c.advice}}


def _finite(x) -> bool:
    return isinstance(x, int | float) and math.isfinite(x)


# -- files --------------------------------------------------------------------


@check("files", "error", "A required file is missing.", "add the file at the dataset root.")
def check_required_files(b, c):
    have = {e.rel for e in b.store.files}
    return [plain(c, f, f"Required file {f} is missing.") for f in ("metadata.json", "calibration.json") if f not in have]


@check("files", "error", "CSV file is empty.", "write the missing rows or delete the file.")
def check_empty_files(b, c):
    empty = b.index.where("NOT is_dir AND ext = '.csv' AND size = 0").select(F.col("rel_path").alias("file"))
    return [findings(empty, c, {}, row=None)]


@check("files", "error", "A declared sensor has no CSV file.", "record the sensor's CSV or take it off the declared list.")
def check_missing_sensor_files(b, c):
    have = set(b.all_files["sensors"])
    return [plain(c, f"sensors/{s}.csv", f"No sensors/{s}.csv for declared sensor '{s}'.", sensor=s) for s in b.declared_sensors if f"sensors/{s}.csv" not in have]


@check("files", "error", "A referenced path does not exist.", "correct the path, relative to the dataset root.")
def check_broken_paths(b, c):
    out = []
    for modality in ("sensors", "labels", "trajectories"):
        df = b.rows(modality, "path")
        if df is None:
            continue
        used = df.select("file", "row", X.text_or_null("path").alias("path")).where("path IS NOT NULL")
        # a column of numbers holds no paths
        texts = used.where(X.num("path").isNull()).select("file").distinct()
        used = used.join(texts, "file", "left_semi").withColumn("__p", F.regexp_replace(F.regexp_replace("path", r"^(\./)+", ""), r"/+$", ""))
        lost = K.broken_links(used, "__p", b.index, "rel_path", guarded=False).where("__p NOT IN ('', '.')")
        out.append(findings(lost, c, {"path": F.col("path")}, message=F.concat(F.lit("No file at referenced path "), F.col("path"), F.lit("."))))
    return out


@check("files", "warning", "A file name is used in several folders.", "give the files distinct names.")
def check_duplicate_filenames(b, c):
    seen = b.index.where("NOT is_dir").where(~F.col("rel_path").rlike(r"(^|/)\."))
    same = seen.groupBy("name").agg(F.array_sort(F.collect_list("rel_path")).alias("paths")).where(F.size("paths") > 1)
    return [findings(same.withColumn("file", F.element_at("paths", 1)), c, {"paths": F.col("paths")}, row=None, message=F.concat(F.lit("File name "), F.col("name"), F.lit(" is used in several folders.")), text="name")]


# -- metadata -----------------------------------------------------------------


@check("metadata", "error", "metadata.json has a field of the wrong kind.", "correct the field in metadata.json.")
def check_metadata_schema(b, c):
    m, out = b.metadata, []
    if m is None:
        return out
    if not isinstance(m.get("dataset_name"), str) or not m["dataset_name"]:
        out.append(plain(c, "metadata.json", "dataset_name must be a non-empty text."))
    if not isinstance(m.get("sensors"), list) or not all(isinstance(s, str) for s in m["sensors"]):
        out.append(plain(c, "metadata.json", "sensors must be a list of texts."))
    d = m.get("duration_sec")
    if not isinstance(d, int | float) or d < 0:
        out.append(plain(c, "metadata.json", "duration_sec must be a number of 0 or more."))
    return out


@check("metadata", "error", "A declared sensor is not among the sensor files.", "record the sensor or correct metadata.json.")
def check_declared_sensors_exist(b, c):
    have = {f.removeprefix("sensors/").removesuffix(".csv") for f in b.all_files["sensors"]}
    return [plain(c, "metadata.json", f"Declared sensor '{s}' is not among the sensor files.", sensor=s) for s in b.declared_sensors if s not in have]


@check("metadata", "warning", "duration_sec differs from the span of the timestamps.", "derive the duration from the recorded times.")
def check_duration_matches_timestamps(b, c):
    declared = (b.metadata or {}).get("duration_sec")
    spans = [df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")) for m in ("sensors", "labels", "trajectories") if (df := b.rows(m, "timestamp")) is not None]
    if not _finite(declared) or not spans:
        return []
    span = spans[0]
    for s in spans[1:]:
        span = span.unionByName(s)
    seen = span.agg((F.max("hi") - F.min("lo")).alias("observed")).where(F.abs(F.lit(float(declared)) - F.col("observed")) > b.config.duration_tolerance_sec)
    seen = seen.withColumn("file", F.lit("metadata.json"))
    return [findings(seen, c, {"declared_duration_sec": F.lit(float(declared)), "observed_duration_sec": F.col("observed")}, row=None)]


@check("metadata", "warning", "metadata.json has no version.", "state a version in metadata.json.")
def check_dataset_version_present(b, c):
    v = (b.metadata or {}).get("version")
    return [plain(c, "metadata.json")] if b.metadata is not None and (not isinstance(v, str) or not v) else []


# -- timestamps ---------------------------------------------------------------


def _timed(b: Bundle):
    for i, m in enumerate(("sensors", "labels", "trajectories")):
        if (df := b.rows(m, "timestamp")) is not None:
            yield i, df


@check("timestamps", "error", "Time runs backwards.", "sort the rows or mend the clock.")
def check_monotonic_timestamps(b, c):
    return [findings(K.backward_steps(df, ["file"], ["row"]), c, {"delta_sec": F.col("delta_sec")}, text=F.concat(F.lit(str(i)), "file")) for i, df in _timed(b)]


@check("timestamps", "warning", "A timestamp occurs again.", "drop repeated rows or record finer times.")
def check_duplicate_timestamps(b, c):
    return [findings(K.repeated_values(df, ["file"], ["row"]), c, {"timestamp": F.col("ts")}, text=F.concat(F.lit(str(i)), "file")) for i, df in _timed(b)]


@check("timestamps", "warning", "Time gap above the threshold.", "look for dropped samples, or raise the threshold.")
def check_large_timestamp_gaps(b, c):
    t = b.config.timestamp_gap_threshold_sec
    return [findings(K.large_gaps(df, ["file"], ["row"], t), c, {"gap_sec": F.col("gap_sec"), "threshold_sec": F.lit(t)}, text=F.concat(F.lit(str(i)), "file")) for i, df in _timed(b)]


# -- sensors ------------------------------------------------------------------


def required_sensor_columns(stream: str) -> tuple[str, ...]:
    return next(v for k, v in SENSOR_COLUMNS.items() if k in stream.lower())


def _lacking(b: Bundle, c: Check, modality: str, need: Callable[[str], tuple[str, ...]], named: bool) -> list:
    out = []
    for file, have in b.headers[modality].items():
        stream = file.rsplit("/", 1)[-1].removesuffix(".csv")
        if missing := sorted(set(need(stream)) - set(have)):
            out.append(plain(c, file, f"Missing columns: {', '.join(missing)}.", **({"sensor": stream} if named else {}), missing_columns=missing))
    return out


@check("sensors", "error", "Sensor columns are missing.", "write all columns that this kind of sensor needs.")
def check_sensor_columns(b, c):
    return _lacking(b, c, "sensors", required_sensor_columns, True)


@check("sensors", "error", "Image width and height must be above 0.", "correct the camera's width and height.")
def check_sensor_dimensions(b, c):
    df = b.rows("sensors", "width", "height")
    if df is None:
        return []
    cameras = df.where(F.lower("stream").contains("camera")).withColumns({"width": X.num("width"), "height": X.num("height")})
    return [findings(K.not_positive(cameras, ["width", "height"]), c, {"sensor": F.col("stream")})]


def _rates(b: Bundle) -> DataFrame | None:
    r = [(s, float(hz), float(i)) for i, (s, hz) in enumerate(b.config.expected_sensor_rates.items()) if hz > 0]
    return b.spark.createDataFrame(r, "stream string, expected_hz double, nth double") if r else None


@check("sensors", "warning", "The rate is off the expected one.", "look for dropped samples, or correct expected_sensor_rates.")
def check_sensor_frequency(b, c):
    df, rates = b.rows("sensors", "timestamp"), _rates(b)
    if df is None or rates is None:
        return []
    off = K.off_rates(df, ["stream"], ["row"], F.broadcast(rates), b.config.frequency_tolerance_fraction)
    off = off.withColumn("file", F.concat(F.lit("sensors/"), "stream", F.lit(".csv")))
    return [findings(off, c, {"sensor": F.col("stream"), "expected_hz": F.col("expected_hz"), "observed_hz": F.col("observed_hz")}, row=None, text=None, num=F.col("nth"))]


@check("sensors", "warning", "Frames seem to be missing.", "look into the gap, or write the index anew.")
def check_missing_frames(b, c):
    df, rates = b.rows("sensors", "timestamp"), _rates(b)
    if df is None:
        return []
    out = K.missing_frames(df, ["stream"], ["row"], b.config.missing_frame_gap_multiplier, F.broadcast(rates) if rates is not None else None)
    return [findings(out, c, {"sensor": F.col("stream"), "gap_sec": F.col("gap_sec"), "expected_gap_sec": F.col("expected_gap_sec")})]


# -- synchronisation ----------------------------------------------------------

TIMING = ("start_time", "end_time", "duration_sec", "frame_count", "median_dt_sec", "max_dt_sec", "inferred_frequency_hz")


def timing_struct() -> Column:
    return F.struct(*[F.col(x).cast("double").alias(x) for x in TIMING])


def _times(b: Bundle) -> DataFrame | None:
    df = b.rows("sensors", "timestamp")
    return None if df is None else K.timings(df, ["stream"])


@check("sync", "error", "Sensors share too little time.", "trim the streams to the time they share, or set their clocks right.")
def check_sensor_time_overlap(b, c):
    if (t := _times(b)) is None:
        return []
    least = b.config.min_overlap_ratio
    low = K.low_overlap(t, least)
    every = t.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", timing_struct().alias("t"))))).alias("sensors"))
    none = every.crossJoin(F.broadcast(K.overlap(t))).where("streams >= 2 AND shared_start > shared_end")
    some = low.where("shared_start <= shared_end").groupBy("overlap_sec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", "overlap_ratio")))).alias("ratios"))
    some = some.crossJoin(every)
    return [
        findings(none, c, {"sensors": F.col("sensors")}, file=None, row=None, text=None, message="The sensors' time ranges have nothing in common."),
        findings(some, c, {"sensors": F.col("sensors"), "overlap_duration_sec": F.col("overlap_sec"), "overlap_ratios": F.col("ratios"), "min_overlap_ratio": F.lit(least)}, file=None, row=None, text=None, severity="warning"),
    ]


@check("sync", "warning", "Two sensors start too far apart.", "start the streams together or set their clocks right.")
def check_timestamp_offset(b, c):
    if (t := _times(b)) is None:
        return []
    limit = b.config.max_pairwise_sync_gap_sec
    out = K.start_offsets(t, "stream", limit)
    meta = {"sensor_a": F.col("a_stream"), "sensor_b": F.col("b_stream"), "start_offset_sec": F.col("start_offset_sec"), "threshold_sec": F.lit(limit)}
    return [findings(out, c, meta, file=None, row=None, text=F.concat_ws("\0", "a_stream", "b_stream"))]


@check("sync", "warning", "Two sensors' samples lie too far apart.", "synchronise the sensors, or raise max_pairwise_sync_gap_sec.")
def check_pairwise_sync_gap(b, c):
    if (df := b.rows("sensors", "timestamp")) is None:
        return []
    limit = b.config.max_pairwise_sync_gap_sec
    out = K.nearest_gaps(df, "stream").where(F.col("median_gap_sec") > limit)
    meta = {"sensor_a": F.col("a"), "sensor_b": F.col("b"), "median_gap_sec": F.col("median_gap_sec"), "max_gap_sec": F.col("max_gap_sec"), "threshold_sec": F.lit(limit)}
    return [findings(out, c, meta, file=None, row=None, text=F.concat_ws("\0", "a", "b"))]


@check("sync", "warning", "A burst of frames is missing.", "look for stalls of the recorder around this time.")
def check_missing_frame_bursts(b, c):
    if (df := b.rows("sensors", "timestamp")) is None:
        return []
    t = b.config.timestamp_gap_threshold_sec
    out = K.bursts(df, ["stream"], ["row"], t)
    meta = {"sensor": F.col("stream"), "gap_sec": F.col("gap_sec"), "threshold_sec": F.lit(t), "estimated_missing_frames": F.col("estimated_missing_frames")}
    return [findings(out.withColumn("file", F.concat(F.lit("sensors/"), "stream", F.lit(".csv"))), c, meta, row=None, num=F.col("ts"))]


@check("sync", "warning", "The time between samples is uneven.", "look for load or transport jitter on this sensor.")
def check_frequency_stability(b, c):
    if (df := b.rows("sensors", "timestamp")) is None:
        return []
    t = b.config.frequency_jitter_ratio
    out = K.jitter(df, ["stream"]).where(F.col("jitter_ratio") > t).withColumn("file", F.concat(F.lit("sensors/"), "stream", F.lit(".csv")))
    return [findings(out, c, {"sensor": F.col("stream"), "jitter_ratio": F.col("jitter_ratio"), "threshold": F.lit(t)}, row=None)]


def sensor_sync_diagnostics(b: Bundle) -> dict:
    """Timings per stream, nearest gaps per pair and the shared time range."""
    if (df := b.rows("sensors", "timestamp")) is None:
        return {"sensors": {}, "pairwise_gaps": {}, "overlap_duration_sec": 0.0}
    times = K.timings(df, ["stream"]).orderBy("stream").collect()
    near = K.nearest_gaps(df, "stream").orderBy("a", "b").collect()
    shared = min((t.end_time for t in times), default=0.0) - max((t.start_time for t in times), default=0.0)
    return {
        "sensors": {t.stream: {x: None if t[x] is None else float(t[x]) for x in TIMING} for t in times},
        "pairwise_gaps": {f"{p.a}:{p.b}": {"median_gap_sec": p.median_gap_sec, "max_gap_sec": p.max_gap_sec} for p in near},
        "overlap_duration_sec": max(0.0, shared),
    }


# -- calibration --------------------------------------------------------------


def _calibrated(b: Bundle) -> list[tuple[str, dict]]:
    return [(s, e) for s, e in (b.calibration or {}).items() if isinstance(e, dict)]


def _vector(v, n: int) -> bool:
    return isinstance(v, list) and len(v) == n and all(map(_finite, v))


def _matrix(m, rows: int, columns: int) -> bool:
    return isinstance(m, list) and len(m) == rows and all(_vector(r, columns) for r in m)


@check("calibration", "error", "A declared sensor has no calibration.", "add the sensor to calibration.json.")
def check_calibration_exists(b, c):
    if b.calibration is None:
        return []
    return [plain(c, "calibration.json", f"Declared sensor '{s}' has no calibration.", sensor=s) for s in b.declared_sensors if s not in b.calibration]


@check("calibration", "error", "Intrinsics must be a 3x3 matrix of numbers.", "write the intrinsics as three rows of three numbers.")
def check_intrinsics_shape(b, c):
    need = lambda s, e: "intrinsics" in e and e["intrinsics"] is not None or "camera" in s.lower()
    return [plain(c, "calibration.json", f"Intrinsics of '{s}' must be a 3x3 matrix of numbers.", sensor=s) for s, e in _calibrated(b) if need(s, e) and not _matrix(e.get("intrinsics"), 3, 3)]


@check("calibration", "error", "Focal lengths must be above 0.", "correct the diagonal of the intrinsics.")
def check_intrinsics_values(b, c):
    bad = lambda m: _matrix(m, 3, 3) and (m[0][0] <= 0 or m[1][1] <= 0)
    return [plain(c, "calibration.json", f"Focal lengths of '{s}' must be above 0.", sensor=s) for s, e in _calibrated(b) if bad(e.get("intrinsics"))]


@check("calibration", "error", "Extrinsics need translation[3] and rotation_quat[4].", "write a translation of three and a quaternion of four numbers.")
def check_extrinsics_shape(b, c):
    good = lambda x: isinstance(x, dict) and _vector(x.get("translation"), 3) and _vector(x.get("rotation_quat"), 4)
    return [plain(c, "calibration.json", f"Extrinsics of '{s}' need translation[3] and rotation_quat[4].", sensor=s) for s, e in _calibrated(b) if not good(e.get("extrinsics"))]


@check("calibration", "error", "The rotation quaternion isn't of unit length.", "normalise the quaternion.")
def check_quaternion_norm(b, c):
    quats = [(float(i), s, [float(x) for x in q]) for i, (s, e) in enumerate(_calibrated(b)) if _vector(q := (e.get("extrinsics") or {}).get("rotation_quat") if isinstance(e.get("extrinsics"), dict) else None, 4)]
    if not quats:
        return []
    df = b.spark.createDataFrame(quats, "i double, sensor string, q array<double>").withColumn("norm", X.norm(F.col("q"))).withColumn("file", F.lit("calibration.json"))
    return [findings(df.where(~X.unit_norm(F.col("norm"))), c, {"sensor": F.col("sensor"), "norm": F.col("norm")}, row=None, num=F.col("i"), message=F.concat(F.lit("The quaternion of '"), F.col("sensor"), F.lit("' isn't of unit length.")))]


# -- labels -------------------------------------------------------------------


def _labels(b: Bundle, *numbers: str, texts: tuple[str, ...] = ()) -> DataFrame | None:
    """Label rows with the columns as numbers; NULL tracks are a group of their own."""
    df = b.rows("labels", *numbers, *texts)
    if df is None:
        return None
    return df.withColumns({n: X.num(n) for n in numbers} | {t: X.text_or_null(t) for t in texts})


def _track_text() -> Column:
    return F.concat(F.col("file"), F.lit("\0"), F.coalesce("track_id", F.lit("\U0010ffff")))


@check("labels", "error", "Label columns are missing.", "write all label columns.")
def check_label_columns(b, c):
    return _lacking(b, c, "labels", lambda _: LABEL_COLUMNS, False)


@check("labels", "error", "Confidence must lie in [0, 1].", "correct the exporter's confidence.")
def check_label_confidence_range(b, c):
    df = _labels(b, "confidence")
    return [] if df is None else [findings(K.out_of_range(df, "confidence", 0, 1), c, {})]


@check("labels", "error", "Box width and height must be above 0.", "correct the box.")
def check_label_geometry(b, c):
    df = _labels(b, "width", "height")
    return [] if df is None else [findings(K.not_positive(df, ["width", "height"]), c, {})]


@check("labels", "error", "The label's time is outside that of all sensors.", "drop the label or record the sensor for its time.")
def check_label_timestamps_match_sensor_range(b, c):
    df, sensors = b.rows("labels", "timestamp"), b.rows("sensors", "timestamp")
    if df is None or sensors is None:
        return []
    return [findings(K.outside_span(df, "ts", sensors, "ts"), c, {"min_sensor_time": F.col("span_start"), "max_sensor_time": F.col("span_end")})]


@check("labels", "warning", "A track changes its class.", "split the track or correct its classes.")
def check_track_id_consistency(b, c):
    df = _labels(b, texts=("track_id", "class", "timestamp"))
    if df is None:
        return []
    t = b.config.label_class_switch_threshold
    out = K.class_switches(df, ["file", "track_id"], ["ts", "row"], "class", t)
    return [findings(out, c, {"track_id": F.col("track_id"), "classes": F.col("classes"), "class_switches": F.col("class_switches"), "threshold": F.lit(t)}, row=None, text=_track_text())]


@check("labels", "warning", "A box jumps.", "look for swapped tracks or a wrong box.")
def check_label_bbox_jumps(b, c):
    df = _labels(b, "timestamp", "x", "y", "width", "height", texts=("track_id",))
    if df is None:
        return []
    t = b.config.label_max_position_jump_px
    out = K.box_jumps(df.where("ts IS NOT NULL"), ["file", "track_id"], ["ts", "row"], t)
    return [findings(out, c, {"track_id": F.col("track_id"), "jump_px": F.col("jump_px"), "threshold_px": F.lit(t)}, text=_track_text(), num=F.col("ts"))]


@check("labels", "warning", "Labels of a track seem to be missing.", "label the frames in the gap.")
def check_label_missing_timestamps(b, c):
    df = _labels(b, "timestamp", texts=("track_id",))
    if df is None:
        return []
    out = K.missing_labels(df, ["file", "track_id"], ["row"])
    meta = {"track_id": F.col("track_id"), "gap_sec": F.col("gap_sec"), "expected_gap_sec": F.col("expected_gap_sec"), "estimated_missing_labels": F.col("estimated_missing_labels")}
    return [findings(out, c, meta, text=_track_text(), num=F.col("ts"))]


@check("labels", "error", "A track has two labels at one time.", "keep one label per track and time.")
def check_duplicate_track_id_timestamp(b, c):
    df = _labels(b, texts=("track_id", "timestamp"))
    if df is None:
        return []
    typed = df.withColumn("__t", F.coalesce(F.col("ts").cast("string"), "timestamp"))
    return [findings(K.shared_keys(typed, ["file", "__t", "track_id"]), c, {"track_id": F.col("track_id"), "timestamp": F.coalesce("ts", F.lit(None).cast("double"))})]


@check("labels", "warning", "A track is too short.", "drop stray tracks, or lower label_min_track_length.")
def check_short_tracks(b, c):
    df = _labels(b, texts=("track_id",))
    if df is None:
        return []
    least = b.config.label_min_track_length
    out = K.short_groups(df, ["file", "track_id"], least)
    return [findings(out, c, {"track_id": F.col("track_id"), "track_length": F.col("track_length"), "minimum_track_length": F.lit(least)}, row=None, text=_track_text())]


@check("labels", "warning", "A box changes its size abruptly.", "look for swapped tracks or a wrong box.")
def check_label_size_changes(b, c):
    df = _labels(b, "timestamp", "width", "height", texts=("track_id",))
    if df is None:
        return []
    t = b.config.label_max_size_change_ratio
    out = K.size_changes(df.where("ts IS NOT NULL"), ["file", "track_id"], ["ts", "row"], t)
    meta = {"track_id": F.col("track_id"), "width_change_ratio": F.col("width_change_ratio"), "height_change_ratio": F.col("height_change_ratio"), "threshold": F.lit(t)}
    return [findings(out, c, meta, text=_track_text(), num=F.col("ts"))]


# -- trajectories -------------------------------------------------------------


def _path_rows(b: Bundle, *numbers: str) -> DataFrame | None:
    df = b.rows("trajectories", *numbers)
    return None if df is None else df.withColumns({n: X.num(n) for n in numbers})


@check("trajectories", "error", "Trajectory columns are missing.", "write all trajectory columns.")
def check_trajectory_columns(b, c):
    return _lacking(b, c, "trajectories", lambda _: TRAJECTORY_COLUMNS, False)


@check("trajectories", "error", "A trajectory value isn't a finite number.", "drop or correct the row.")
def check_trajectory_finite_values(b, c):
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, have in b.headers["trajectories"].items():
        groups.setdefault(tuple(x for x in TRAJECTORY_COLUMNS if x in have), []).append(file)
    out = []
    for columns, files in groups.items():
        if columns:
            df = _path_rows(b, *columns).where(F.col("file").isin(*files))
            out.append(findings(K.not_finite(df, list(columns)), c, {}))
    return out


@check("trajectories", "warning", "Speed above the limit.", "check units and times, or raise max_speed_mps.")
def check_unrealistic_speed(b, c):
    df, t = _path_rows(b, "vx", "vy"), b.config.max_speed_mps
    return [] if df is None else [findings(K.fast_rows(df, t), c, {"speed_mps": F.col("speed_mps"), "max_speed_mps": F.lit(t)})]


@check("trajectories", "warning", "Acceleration above the limit.", "check units and times, or raise max_accel_mps2.")
def check_unrealistic_acceleration(b, c):
    df, t = _path_rows(b, "timestamp", "vx", "vy"), b.config.max_accel_mps2
    if df is None:
        return []
    return [findings(K.hard_accelerations(df, ["file"], ["row"], t), c, {"acceleration_mps2": F.col("acceleration_mps2"), "max_accel_mps2": F.lit(t)})]


@check("trajectories", "warning", "Yaw must lie in [-pi, pi].", "write yaw in radians, wrapped to [-pi, pi].")
def check_yaw_range(b, c):
    df = _path_rows(b, "yaw")
    return [] if df is None else [findings(K.out_of_range(df, "yaw", -math.pi, math.pi, null_passes=True), c, {})]


@check("trajectories", "warning", "The trajectory hardly moves.", "check that poses were recorded.")
def check_stationary_dataset(b, c):
    df, t = _path_rows(b, "x", "y"), b.config.stationary_distance_threshold_m
    return [] if df is None else [findings(K.stationary(df, ["file"], t), c, {"distance_m": F.col("distance_m"), "threshold_m": F.lit(t)}, row=None)]


GROUPS: dict[str, list[str]] = {}
for _name, _check in CHECKS.items():
    GROUPS.setdefault(_check.group, []).append(_name)
