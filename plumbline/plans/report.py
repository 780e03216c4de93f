"""Lint reports and their renderings."""

from __future__ import annotations

import dataclasses
import html
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from plumbline import __version__
from plumbline.plans.policy import SEVERITIES, should_fail


def now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def cell(x) -> str:
    """Text that can't break a Markdown table."""
    return "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").replace("\r", " ")


@dataclass
class Issue:
    check_name: str
    severity: str
    message: str
    file: str | None = None
    row: int | None = None
    metadata: dict = field(default_factory=dict)


@dataclass
class LintReport:
    dataset_path: str
    issues: list[Issue] = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    passed: bool = True
    generated_at: str = field(default_factory=now)
    dataset_summary: dict = field(default_factory=dict)
    checks_run: list[str] = field(default_factory=list)
    adapter: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    dataset_fingerprint: str | None = None
    plumbline_version: str = __version__

    def count_by_severity(self) -> dict[str, int]:
        return {s: sum(i.severity == s for i in self.issues) for s in SEVERITIES}

    def should_fail(self, fail_on: str) -> bool:
        return should_fail(self.count_by_severity(), fail_on)

    def summary(self) -> str:
        n = self.count_by_severity()
        return f"{self.dataset_path}: {'passed' if self.passed else 'failed'}, {len(self.issues)} findings ({', '.join(f'{n[s]} {s}' for s in reversed(SEVERITIES))})"

    def to_dict(self) -> dict:
        d = dataclasses.asdict(self)
        return d | {"findings": d["issues"]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True, default=str)

    def to_markdown(self) -> str:
        """The verdict, the findings file by file, then what was measured."""
        n = self.count_by_severity()
        told = ", ".join(f"{n[s]} of severity {s}" for s in reversed(SEVERITIES) if n[s]) or "no findings"
        out = [f"# {'Passed' if self.passed else 'Failed'}: {cell(self.dataset_path)}", "", f"{len(self.checks_run)} checks, {told}.", ""]
        by_file: dict[str, list[Issue]] = {}
        for i in self.issues:
            by_file.setdefault(i.file or "Whole dataset", []).append(i)
        for file, found in by_file.items():
            out += [f"### {cell(file)}", ""]
            out += [f"* {i.severity}, {i.check_name}{'' if i.row is None else f', row {i.row}'}: {cell(i.message)}" for i in found]
            out.append("")
        if self.stats:
            out += ["## Measured", "", "```json", json.dumps(self.stats, indent=2, sort_keys=True), "```", ""]
        return "\n".join([*out, f"_Made {self.generated_at} by version {self.plumbline_version}; fingerprint {self.dataset_fingerprint}._", ""])

    def to_html(self) -> str:
        """The same on every run for the same findings: no time of making."""
        e = lambda x: html.escape("" if x is None else str(x))
        stats = "".join(f"<tr><th>{e(k)}</th><td><pre>{e(json.dumps(v, indent=2, sort_keys=True))}</pre></td></tr>" for k, v in sorted(self.stats.items()))
        rows = "".join(f'<tr class="{e(i.severity)}"><td>{e(i.severity)}</td><td>{e(i.check_name)}</td><td>{e(i.file)}</td><td>{e(i.row)}</td><td>{e(i.message)}</td></tr>' for i in self.issues)
        style = "body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:4px;text-align:left}.error td:first-child{color:#b00}.warning td:first-child{color:#a60}"
        return (
            f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Dataset report</title><style>{style}</style></head><body>'
            f"<h1>{e(self.summary())}</h1><p>Fingerprint: <code>{e(self.dataset_fingerprint)}</code></p><table>{stats}</table>"
            f"<table><tr><th>Severity</th><th>Check</th><th>File</th><th>Row</th><th>Message</th></tr>{rows}</table></body></html>\n"
        )

    def to_text(self) -> str:
        return "\n".join([self.summary(), *(f"{i.severity:8} {i.check_name:42} {(i.file or '-') + (f':{i.row}' if i.row else ''):36} {i.message}" for i in self.issues)])
