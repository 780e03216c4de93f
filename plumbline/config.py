"""Thresholds and rule selection; closed sets of keys."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field

SEVERITIES = ("info", "warning", "error")
CONFIG_NAME = "plumbline.yaml"


@dataclass(frozen=True)
class Rules:
    enabled: list[str] | None = None
    disabled: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class LintConfig:
    # fixed default values
    timestamp_gap_threshold_sec: float = 0.5
    frequency_tolerance_fraction: float = 0.30
    missing_frame_gap_multiplier: float = 1.5
    max_speed_mps: float = 70.0
    max_accel_mps2: float = 12.0
    stationary_distance_threshold_m: float = 0.05
    duration_tolerance_sec: float = 1.0
    label_max_position_jump_px: float = 200.0
    label_max_size_change_ratio: float = 3.0
    label_min_track_length: int = 3
    label_class_switch_threshold: int = 0
    max_pairwise_sync_gap_sec: float = 0.05
    min_overlap_ratio: float = 0.8
    frequency_jitter_ratio: float = 0.2
    frame_count_drop_ratio_warning: float = 0.1
    duration_drop_ratio_warning: float = 0.1
    issue_regression_severity: str = "warning"
    rules: Rules = field(default_factory=Rules)
    expected_sensor_rates: dict[str, float] = field(default_factory=lambda: {"camera_front": 10.0, "camera_rear": 10.0, "imu": 100.0, "gps": 10.0})

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


def _checked(cls, values: dict, where: str):
    if not isinstance(values, dict):
        raise ValueError(f"{where} must be a mapping")
    known = {f.name: f for f in dataclasses.fields(cls)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{where} has unknown keys: {', '.join(unknown)}")
    out = {}
    for k, v in values.items():
        kind = str(known[k].type)
        if kind in ("float", "int"):
            if isinstance(v, bool) or not isinstance(v, int | float) or kind == "int" and v != int(v):
                raise ValueError(f"{where}.{k} must be a number")
            v = float(v) if kind == "float" else int(v)
        out[k] = v
    return out


def make_config(values: dict) -> LintConfig:
    """A config from plain values; unknown keys and wrong types are errors."""
    values = _checked(LintConfig, dict(values), "config")
    if "rules" in values:
        r = _checked(Rules, values["rules"] or {}, "rules")
        for k in ("enabled", "disabled"):
            if isinstance(r.get(k), str):
                r[k] = [r[k]]
        values["rules"] = Rules(**r)
    config = LintConfig(**values)
    for name, s in [("issue_regression_severity", config.issue_regression_severity), *config.rules.severity.items()]:
        if s not in SEVERITIES:
            raise ValueError(f"{name}: unknown severity {s!r}")
    rates = config.expected_sensor_rates
    if not isinstance(rates, dict) or any(isinstance(v, bool) or not isinstance(v, int | float) for v in rates.values()):
        raise ValueError("expected_sensor_rates must map sensors to numbers")
    return config


def load_config(config, dataset: str | None = None) -> LintConfig:
    """From a config, a mapping, a path, or the dataset's own file; defaults otherwise."""
    if isinstance(config, LintConfig):
        return config
    if isinstance(config, dict):
        return make_config(config)
    path = config
    if path is None and dataset and os.path.isfile(os.path.join(dataset, CONFIG_NAME)):
        path = os.path.join(dataset, CONFIG_NAME)
    if path is None:
        return LintConfig()
    with open(path, encoding="utf-8") as f:
        return make_config(parse_yaml(f.read()) or {})


def parse_yaml(text: str):
    """PyYAML where it is there, else nested mappings and lists of scalars by indentation."""
    try:
        import yaml
    except ImportError:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for raw in text.splitlines() if (x := _without_comment(raw)).strip()]
        return _block(lines, 0, lines[0][0] if lines else 0)[0] if lines else {}
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"bad YAML: {e}") from e


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith(("[", "{")):
        try:
            return json.loads(text)
        except ValueError:
            return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _block(lines: list[tuple[int, str]], at: int, depth: int):
    if lines[at][1].startswith("- "):
        out = []
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
            out.append(_scalar(lines[at][1][2:]))
            at += 1
        return out, at
    made: dict = {}
    while at < len(lines) and lines[at][0] == depth:
        key, colon, rest = lines[at][1].partition(":")
        if not colon:
            raise ValueError(f"bad YAML line: {lines[at][1]!r}")
        key = str(_scalar(key))
        at += 1
        if rest.strip():
            made[key] = _scalar(rest)
        elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
            made[key], at = _block(lines, at, lines[at][0])
        else:
            made[key] = None
    if at < len(lines) and lines[at][0] > depth:
        raise ValueError(f"bad YAML indentation: {lines[at][1]!r}")
    return made, at
