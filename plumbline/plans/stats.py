"""Dataset statistics: each summary is one aggregate over a bundle's frames."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import LintConfig, load_config
from plumbline.functions import exprs as X
from plumbline.operators import kernels as K
from plumbline.plans.lint import lint_bundle, select_checks, without_overlaps
from plumbline.session import session
from plumbline.sources.bundle import Bundle, load_bundle


@dataclass
class NumericSummary:
    count: int = 0
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    median: float | None = None


@dataclass
class DatasetStats:
    dataset_path: str
    duration_sec: float | None = None
    sensors: list[str] = field(default_factory=list)
    frame_counts: dict[str, int] = field(default_factory=dict)
    inferred_rates_hz: dict[str, float] = field(default_factory=dict)
    label_class_counts: dict[str, int] = field(default_factory=dict)
    confidence_summary: NumericSummary = field(default_factory=NumericSummary)
    track_length_summary: NumericSummary = field(default_factory=NumericSummary)
    speed_summary: NumericSummary = field(default_factory=NumericSummary)
    acceleration_summary: NumericSummary = field(default_factory=NumericSummary)
    missing_frame_counts: dict[str, int] = field(default_factory=dict)
    issue_summary: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2, sort_keys=True)

    def to_markdown(self) -> str:
        show = lambda x: "n/a" if x is None else f"{x:.6g}"
        out = [f"# Statistics of `{self.dataset_path}`", "", f"- Duration: {show(self.duration_sec)} s", "", "| Sensor | Frames | Rate (Hz) | Long gaps |", "| --- | --- | --- | --- |"]
        out += [f"| {s} | {self.frame_counts.get(s, 0)} | {show(self.inferred_rates_hz.get(s))} | {self.missing_frame_counts.get(s, 0)} |" for s in self.sensors]
        out += ["", "| Values | Count | Min | Max | Mean | Median |", "| --- | --- | --- | --- | --- | --- |"]
        for name in ("confidence", "track_length", "speed", "acceleration"):
            s = getattr(self, f"{name}_summary")
            out.append(f"| {name} | {s.count} | {show(s.min)} | {show(s.max)} | {show(s.mean)} | {show(s.median)} |")
        out += ["", "| Class | Labels |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in self.label_class_counts.items())]
        out += ["", "| Severity | Findings |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in self.issue_summary.items())]
        return "\n".join([*out, ""])


def _summary(df: DataFrame | None, column) -> NumericSummary:
    if df is None:
        return NumericSummary()
    r = K.numeric_summary(df, column).first()
    num = lambda x: None if x is None else float(x)
    return NumericSummary(r["count"], num(r.min), num(r.max), num(r.mean), num(r.median))


def _pairs(df: DataFrame | None, key: str, value: str) -> dict:
    return {} if df is None else {r[key]: r[value] for r in df.orderBy(key).collect()}


def bundle_stats(b: Bundle, issues=None) -> DatasetStats:
    frames, timed = b.frames.get("sensors"), b.rows("sensors", "timestamp")
    stats = DatasetStats(b.store.root, sensors=sorted(f.removeprefix("sensors/").removesuffix(".csv") for f in b.headers["sensors"]))
    if frames is not None:
        counts = _pairs(frames.groupBy("stream").count(), "stream", "count")
        stats.frame_counts = {s: counts.get(s, 0) for s in stats.sensors}
    if timed is not None:
        span = timed.agg((F.max("ts") - F.min("ts")).alias("d")).first().d
        stats.duration_sec = None if span is None else max(0.0, span)
        rates = K.timings(timed, ["stream"]).where("inferred_frequency_hz IS NOT NULL").select("stream", F.round("inferred_frequency_hz", 6).alias("hz"))
        stats.inferred_rates_hz = _pairs(rates, "stream", "hz")
        gaps = K.gaps(timed, ["stream"], ["row"], "ts", "sorted").groupBy("stream").agg(F.count_if(F.col("gap_sec") > b.config.timestamp_gap_threshold_sec).alias("n"))
        stats.missing_frame_counts = _pairs(gaps, "stream", "n")
    if (df := b.rows("labels", "class")) is not None:
        stats.label_class_counts = _pairs(K.value_counts(df.withColumn("c", X.text_or_null("class")), "c"), "c", "n")
    stats.confidence_summary = _summary(b.rows("labels", "confidence"), X.num("confidence")) if b.rows("labels", "confidence") is not None else NumericSummary()
    if (df := b.rows("labels", "track_id")) is not None:
        stats.track_length_summary = _summary(df.groupBy("file", X.text_or_null("track_id").alias("t")).count(), "count")
    if (df := b.rows("trajectories", "vx", "vy")) is not None:
        moving = df.withColumns({"vx": X.num("vx"), "vy": X.num("vy")})
        stats.speed_summary = _summary(moving, K.speed())
        if (timed := b.rows("trajectories", "timestamp", "vx", "vy")) is not None:
            moving = timed.withColumns({"vx": X.num("vx"), "vy": X.num("vy")})
            stats.acceleration_summary = _summary(K.accelerations(moving, ["file"], ["row"]), F.abs("acceleration_mps2"))
    if issues is None:
        issues = lint_bundle(b, without_overlaps(select_checks(LintConfig())))
    stats.issue_summary = {s: sum(i.severity == s for i in issues) for s in ("error", "info", "warning")}
    return stats


def compute_dataset_stats(path: str, config=None, spark: SparkSession | None = None) -> DatasetStats:
    bundle = load_bundle(spark or session(), path, load_config(config, path))
    stats = bundle_stats(bundle)
    bundle.release()
    return stats


