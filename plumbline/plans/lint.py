"""Lint: load a folder, run the chosen checks as one plan, make a report."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import LintConfig, load_config
from plumbline.operators.checks import CHECKS, FINDING, GROUPS, sensor_sync_diagnostics
from plumbline.plans.policy import overridden
from plumbline.plans.report import Issue, LintReport
from plumbline.sources.bundle import Bundle, load_bundle


def _names(rule: str) -> list[str]:
    if rule == "all":
        return list(CHECKS)
    if rule in GROUPS:
        return GROUPS[rule]
    if rule in CHECKS:
        return [rule]
    raise ValueError(f"unknown check or group: {rule}")


def _listed(checks) -> list[str]:
    parts = checks.split(",") if isinstance(checks, str) else [p for c in checks for p in str(c).split(",")]
    return [p.strip().lower() for p in parts if p.strip()]


def validate_checks(checks) -> None:
    for name in _listed(checks or []):
        _names(name)


def select_checks(config: LintConfig, checks=None) -> list[str]:
    """Checks to run, in order, each once; ``checks`` beats the configured ones, disabled ones always go."""
    for name in config.rules.severity:
        if name not in CHECKS:
            raise ValueError(f"rules.severity: {name} is not a check")
    wanted = _listed(checks) if checks is not None else _listed(config.rules.enabled) if config.rules.enabled is not None else ["all"]
    off = {n for r in _listed(config.rules.disabled) for n in _names(r)}
    return [n for n in dict.fromkeys(n for r in wanted for n in _names(r)) if n not in off]


def without_overlaps(names: list[str]) -> list[str]:
    """Bursts are long gaps too: one report of them is enough."""
    return [n for n in names if n != "check_missing_frame_bursts" or "check_large_timestamp_gaps" not in names]


def run_checks(bundle: Bundle, names: list[str]) -> DataFrame:
    """All findings of the checks as one DataFrame, severities overridden."""
    frames, rows = [], []
    for at, name in enumerate(names):
        for i, found in enumerate(CHECKS[name].run(bundle, CHECKS[name])):
            if isinstance(found, DataFrame):
                frames.append(found.withColumn("place", F.lit(at)))
            else:
                rows.append((found["check_name"], found["severity"], found["message"], found["file"], found["row"], json.dumps(found["metadata"]), at, "", float(i), 0))
    if rows:
        frames.append(bundle.spark.createDataFrame(rows, FINDING))
    if not frames:
        return bundle.spark.createDataFrame([], FINDING)
    return overridden(reduce(DataFrame.unionByName, frames), bundle.config.rules.severity)


ORDER = ["place", "k_text", "k_num", "k_row"]


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(*ORDER)


def to_issues(found: DataFrame) -> list[Issue]:
    return [Issue(r.check_name, r.severity, r.message, r.file, r.row, json.loads(r.metadata)) for r in ordered(found).collect()]


def lint_bundle(bundle: Bundle, names: list[str]) -> list[Issue]:
    load = [Issue(f["check"], f["severity"], f["message"], f["file"], None, {}) for f in bundle.load_findings]
    return load + to_issues(run_checks(bundle, names))


def check_sensor_synchronization(bundle: Bundle) -> list[Issue]:
    """Findings of all checks on how sensors go together in time."""
    return to_issues(run_checks(bundle, GROUPS["sync"]))


def check_label_consistency(bundle: Bundle) -> list[Issue]:
    """Findings of all checks on labels along their tracks."""
    return to_issues(run_checks(bundle, GROUPS["labels"]))


def lint_dataset(path: str, config=None, checks=None, adapter=None, spark: SparkSession | None = None) -> LintReport:
    """Lint a native dataset folder; the report holds every finding in order."""
    from plumbline.session import session

    spark = spark or session()
    try:
        cfg = load_config(config, path)
        names = without_overlaps(select_checks(cfg, checks))
    except (ValueError, OSError) as e:
        return LintReport(path, [Issue("load_config", "error", str(e))], {}, False)
    from plumbline.sources.adapters import select_adapter

    if adapter not in (None, "auto", "folder"):
        try:
            select_adapter(path, adapter, spark)
        except Exception as e:  # noqa: BLE001  any failure to select is one finding
            return LintReport(path, [Issue("load_dataset", "error", str(e))], {}, False)
        return LintReport(path, [Issue("load_dataset", "error", f"Datasets of format '{adapter}' can be inspected and validated, but not linted.")], {}, False)
    bundle = load_bundle(spark, path, cfg)
    if not bundle.store.exists() or bundle.store.single_file:
        return LintReport(path, [Issue("load_dataset", "error", f"{path} is not a folder.")], {}, False)
    issues = lint_bundle(bundle, names)
    counts = {s: sum(i.severity == s for i in issues) for s in ("error", "info", "warning")}
    stats = {
        "declared_sensor_count": len(bundle.declared_sensors),
        "issue_count": len(issues),
        "issue_count_by_severity": counts,
        "sensor_count": len(bundle.headers["sensors"]),
        "label_file_count": len(bundle.headers["labels"]),
        "trajectory_file_count": len(bundle.headers["trajectories"]),
        "sync": sensor_sync_diagnostics(bundle),
    }
    meta = bundle.metadata or {}
    summary = {
        "dataset_name": meta.get("dataset_name"),
        "version": meta.get("version"),
        "sensors": sorted(f.removeprefix("sensors/").removesuffix(".csv") for f in bundle.headers["sensors"]),
        "modalities": [m for m in ("sensors", "labels", "trajectories") if bundle.headers[m]] + (["calibration"] if bundle.calibration is not None else []),
    }
    bundle.release()
    return LintReport(path, issues, stats, counts["error"] == 0, dataset_summary=summary, checks_run=names, adapter={"name": "folder"}, config=cfg.to_dict(), dataset_fingerprint=bundle.store.digest())
