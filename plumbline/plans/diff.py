"""Comparison of two dataset folders, changes sorted into regressions and improvements."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from plumbline.config import load_config
from plumbline.plans.lint import lint_bundle, select_checks, without_overlaps
from plumbline.plans.report import cell
from plumbline.plans.stats import DatasetStats, bundle_stats
from plumbline.session import session
from plumbline.sources.bundle import load_bundle

#: Checks whose numbers of findings are compared one by one.
WATCHED = ("check_large_timestamp_gaps", "check_missing_frames", "check_pairwise_sync_gap", "check_label_bbox_jumps")


@dataclass
class DatasetChange:
    category: str
    name: str
    old_value: object = None
    new_value: object = None
    delta: object = None
    severity: str = "info"
    message: str = ""


@dataclass
class DatasetDiffReport:
    old_path: str
    new_path: str
    changes: list[DatasetChange] = field(default_factory=list)
    regressions: list[DatasetChange] = field(default_factory=list)
    improvements: list[DatasetChange] = field(default_factory=list)
    summary: dict = field(default_factory=dict)

    def add(self, change: DatasetChange, kind: str = "neutral") -> None:
        self.changes.append(change)
        if kind != "neutral":
            (self.regressions if kind == "regression" else self.improvements).append(change)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2, sort_keys=True, default=str)

    def to_markdown(self) -> str:
        out = ["# Dataset comparison", "", f"- Old: `{self.old_path}`", f"- New: `{self.new_path}`"]
        for name in ("regressions", "improvements", "changes"):
            rows = getattr(self, name)
            out += ["", f"## {name.capitalize()} ({len(rows)})", ""]
            if rows:
                out += ["| Severity | Category | Name | Old | New | Message |", "| --- | --- | --- | --- | --- | --- |"]
                out += [f"| {c.severity} | {cell(c.category)} | {cell(c.name)} | {cell(c.old_value)} | {cell(c.new_value)} | {cell(c.message)} |" for c in rows]
        return "\n".join([*out, ""])


def lost_share(old: float, new: float) -> float:
    return (old - new) / old if new < old and old > 0 else 0.0


def compare_stats(report: DatasetDiffReport, old: DatasetStats, new: DatasetStats, config, documents, checks) -> None:
    """``documents``: name -> (old, new) JSON; ``checks``: (old, new) numbers of findings by check."""
    bad = config.issue_regression_severity
    for name, (a, b) in documents.items():
        if a != b:
            worse = name == "calibration"
            report.add(DatasetChange(name, f"{name}.json", a, b, None, bad if worse else "info", f"{name}.json differs"), "regression" if worse else "neutral")
    for s in sorted(set(old.sensors) - set(new.sensors)):
        report.add(DatasetChange("sensors", s, True, False, None, "warning", f"sensor {s} is gone"), "regression")
    for s in sorted(set(new.sensors) - set(old.sensors)):
        report.add(DatasetChange("sensors", s, False, True, None, "info", f"sensor {s} is new"), "improvement")
    a, b = old.duration_sec, new.duration_sec
    if a != b:
        worse = a is not None and lost_share(a, b or 0.0) > config.duration_drop_ratio_warning
        report.add(DatasetChange("duration", "duration_sec", a, b, None if a is None or b is None else b - a, "warning" if worse else "info", "the duration differs"), "regression" if worse else "neutral")
    for s in sorted(set(old.frame_counts) | set(new.frame_counts)):
        x, y = old.frame_counts.get(s, 0), new.frame_counts.get(s, 0)
        if x != y:
            worse = lost_share(x, y) > config.frame_count_drop_ratio_warning
            kind = "regression" if worse else "improvement" if y > x else "neutral"
            report.add(DatasetChange("frame_counts", s, x, y, y - x, "warning" if worse else "info", f"{s} has {y} frames, had {x}"), kind)
    for s in sorted(set(old.inferred_rates_hz) | set(new.inferred_rates_hz)):
        x, y = old.inferred_rates_hz.get(s), new.inferred_rates_hz.get(s)
        if x != y:
            report.add(DatasetChange("frequency", s, x, y, None if x is None or y is None else y - x, "info", f"the rate of {s} differs"))
    for c in sorted(set(old.label_class_counts) | set(new.label_class_counts)):
        x, y = old.label_class_counts.get(c, 0), new.label_class_counts.get(c, 0)
        if x != y:
            kind = "regression" if y == 0 else "improvement" if x == 0 else "neutral"
            report.add(DatasetChange("label_classes", c, x, y, y - x, "warning" if y == 0 else "info", f"class {c} has {y} labels, had {x}"), kind)
    for s in ("error", "warning", "info"):
        x, y = old.issue_summary.get(s, 0), new.issue_summary.get(s, 0)
        if x != y:
            worse = y > x and s != "info"
            report.add(DatasetChange("issues", s, x, y, y - x, bad if worse else "info", f"{y} findings of severity {s}, had {x}"), "regression" if worse else "improvement" if y < x else "neutral")
    for c in WATCHED:
        x, y = checks[0].get(c, 0), checks[1].get(c, 0)
        if x != y:
            report.add(DatasetChange("checks", c, x, y, y - x, bad if y > x else "info", f"{y} findings of {c}, had {x}"), "regression" if y > x else "improvement")
    for name, x, y in (("speed", old.speed_summary.max, new.speed_summary.max), ("acceleration", old.acceleration_summary.max, new.acceleration_summary.max)):
        if x != y:
            worse = x is not None and y is not None and y > x
            report.add(DatasetChange("trajectory", f"max_{name}", x, y, y - x if x is not None and y is not None else None, bad if worse else "info", f"the largest {name} differs"), "regression" if worse else "neutral")


def compare_datasets(old: str, new: str, config=None, spark: SparkSession | None = None) -> DatasetDiffReport:
    """Each folder is loaded and linted once; statistics come from the same frames."""
    spark = spark or session()
    cfg = load_config(config, new)
    report = DatasetDiffReport(old, new)
    bundles = [load_bundle(spark, p, cfg) for p in (old, new)]
    names = without_overlaps(select_checks(cfg))
    issues = [lint_bundle(b, names) for b in bundles]
    stats = [bundle_stats(b, i) for b, i in zip(bundles, issues, strict=True)]
    counts = [{c: sum(i.check_name == c for i in found) for c in WATCHED} for found in issues]
    documents = {n: tuple(getattr(b, n) for b in bundles) for n in ("metadata", "calibration")}
    compare_stats(report, *stats, cfg, documents, counts)
    for b in bundles:
        b.release()
    report.summary = {"changes": len(report.changes), "regressions": len(report.regressions), "improvements": len(report.improvements)}
    return report
