"""Adapters: a dataset layout in, a manifest and a validation report out."""

from __future__ import annotations

import importlib.util
import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import rules
from plumbline.sources.files import Store
from plumbline.sources.manifest import TABLES, Manifest, make_manifest


class AdapterError(Exception):
    """Any failure of an adapter."""


class AdapterNotFoundError(AdapterError):
    pass


class AdapterDetectionError(AdapterError):
    pass


class AdapterDependencyError(AdapterError):
    pass


class AdapterValidationError(AdapterError):
    pass


class UnsupportedDatasetFeature(AdapterError):
    pass


@dataclass
class ValidationReport:
    adapter_name: str
    dataset_root: str
    detected: bool
    valid: bool
    validation_mode: str = "manifest-level"
    checked: list[str] = field(default_factory=list)
    not_checked: list[str] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    coverage: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True, default=str)

    def to_markdown(self) -> str:
        out = [f"# {self.adapter_name}: {'valid' if self.valid else 'not valid'}", "", f"- Root: `{self.dataset_root}`", f"- Mode: {self.validation_mode}"]
        for name in ("checked", "not_checked", "limitations", "errors", "warnings"):
            out += ["", f"## {name.replace('_', ' ').capitalize()}", "", *(f"- {x}" for x in getattr(self, name) or ["none"])]
        return "\n".join([*out, ""])


@dataclass
class Options:
    """How deep to look; ``max_rows`` bounds deep samples over all files together."""

    deep: bool = False
    max_rows: int = 1000
    allow_large_sample: bool = False
    split: str | None = None
    streaming: bool = False
    reader: object | None = None  # stands in for an optional parser package


@dataclass
class Found:
    """What a layout holds, as plain records; a table may also be a DataFrame."""

    name: str
    version: str | None = None
    rows: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    limitations: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Adapter:
    name = "base"
    needs: tuple[str, ...] = ()
    mode = "manifest-level"
    checked: tuple[str, ...] = ("sequence, frame and sensor links", "referenced files", "timestamp order and gaps", "split members")
    not_checked: tuple[str, ...] = ("payload contents",)

    def can_load(self, store: Store) -> bool:
        return False

    def find(self, spark: SparkSession, store: Store, options: Options) -> Found:
        raise NotImplementedError

    def problems(self, spark: SparkSession, store: Store, manifest: Manifest, options: Options) -> tuple[list[str], list[str]]:
        """Errors and warnings of this layout beyond the common rules."""
        return [], []

    def scope(self, options: Options) -> tuple[str, list[str], list[str]]:
        return self.mode, list(self.checked), list(self.not_checked)

    def availability(self) -> dict[str, bool]:
        return {p: importlib.util.find_spec(p) is not None for p in self.needs}

    def load(self, root: str, spark: SparkSession, options: Options | None = None) -> Manifest:
        options = options or Options()
        store = Store(root, spark)
        found = self.find(spark, store, options)
        provenance = {
            "source_format": self.name,
            "adapter_version": "1",
            "loaded_at": datetime.now(UTC).replace(microsecond=0).isoformat(),
            "root_hash": store.digest() if store.entries else None,
            "files_indexed": len(store.files),
            "warnings": found.warnings,
        }
        return make_manifest(spark, found.name, self.name, str(root), found.rows, version=found.version, metadata=found.metadata, limitations=found.limitations, provenance=provenance)

    def validate(self, root: str, spark: SparkSession, options: Options | None = None) -> ValidationReport:
        options = options or Options()
        store = Store(root, spark)
        mode, checked, not_checked = self.scope(options)
        report = ValidationReport(self.name, str(root), self.can_load(store), False, mode, checked, not_checked)
        if not report.detected:
            report.errors.append(f"{root} isn't a dataset of format {self.name}")
            return report
        try:
            m = self.load(root, spark, options)
            errors, warnings = self.problems(spark, store, m, options)
            for r in rules.run_rules(m, store.index(spark)).collect():
                (errors if r.kind == "error" else warnings).append(r.message)
        except AdapterDependencyError:
            raise
        except Exception as e:  # noqa: BLE001  a layout that can't be loaded is a finding
            report.errors.append(f"load failed: {e}")
            return report
        parse = [w for w in m.provenance["warnings"] if w.startswith("parse error")]
        report.limitations = m.limitations
        report.errors = unique([*parse, *errors])
        report.warnings = unique([*(w for w in m.provenance["warnings"] if w not in parse), *warnings, *m.limitations])
        counts = m.counts()
        report.coverage = {t: n > 0 for t, n in counts.items()} | {"timestamps": not m.timestamps().isEmpty()}
        report.stats = {f"{t}_count": counts[t] for t in TABLES} | {
            "timestamps": {r.sensor_id: {"count": r["count"], "min": r.min, "max": r.max} for r in rules.timestamp_stats(m).collect()},
            "sync": {f"{r.a}:{r.b}": {"median_gap_sec": r.median_gap_sec, "max_gap_sec": r.max_gap_sec} for r in rules.sync_stats(m).where(~F.col("disjoint")).collect()},
        }
        report.valid = not report.errors
        return report


def unique(xs: list[str]) -> list[str]:
    return list(dict.fromkeys(xs))


def sensors_of(frames: list[dict], kinds: dict[str, str]) -> list[dict]:
    """One sensor record per sensor id seen, with its number of frames."""
    n: dict[str, int] = {}
    for f in frames:
        n[f["sensor_id"]] = n.get(f["sensor_id"], 0) + 1
    return [{"sensor_id": s, "sensor_type": kinds.get(s, "other"), "name": s, "modality": kinds.get(s, "other"), "frame_count": k} for s, k in n.items()]


def sequences_of(frames: list[dict], splits: dict[str, str] | None = None) -> list[dict]:
    """One sequence record per sequence id seen, with count and time range."""
    out: dict[str, dict] = {}
    for f in frames:
        s = out.setdefault(f["sequence_id"], {"sequence_id": f["sequence_id"], "name": f["sequence_id"], "split": (splits or {}).get(f["sequence_id"]), "frame_count": 0})
        s["frame_count"] += 1
        if (t := f.get("timestamp")) is not None:
            s["start_time"] = min(t, s.get("start_time", t))
            s["end_time"] = max(t, s.get("end_time", t))
    return list(out.values())
