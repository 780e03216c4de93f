"""Command line: lint, report, stats, diff, adapters, inspect, validate, export-manifest.

Exit codes: 0 fine, 1 a gate tripped or a dataset isn't valid, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Validate, profile and compare sensor datasets on Spark.")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, paths=("path",), formats=("console", "json", "markdown")):
        v = sub.add_parser(name)
        for x in paths:
            v.add_argument(x)
        v.add_argument("--format", choices=formats, default=formats[0])
        return v

    for name in ("lint", "report"):
        v = verb(name, formats=("console", "json", "markdown", "html"))
        v.add_argument("--config")
        v.add_argument("--checks")
        v.add_argument("--adapter")
        v.add_argument("--fail-on", choices=("error", "warning", "any"), default="error")
        if name == "report":
            v.add_argument("--output", required=True)
    verb("stats").add_argument("--config")
    v = verb("diff", ("old", "new"))
    v.add_argument("--config")
    v.add_argument("--fail-on-regression", action="store_true")
    v = sub.add_parser("adapters")
    v.add_argument("path", nargs="?")
    v.add_argument("--format", choices=("console", "json"), default="console")
    for name in ("inspect", "validate", "export-manifest"):
        v = verb(name)
        v.add_argument("--adapter")
        v.add_argument("--deep", action="store_true")
        v.add_argument("--max-rows", type=int, default=1000)
        v.add_argument("--allow-large-sample", action="store_true")
        v.add_argument("--split")
        v.add_argument("--streaming", action="store_true")
        if name == "export-manifest":
            v.add_argument("--output", required=True)
    return p


def _rendered(x, form: str) -> str:
    if form == "json":
        return x.to_json()
    if form == "html":
        return x.to_html()
    if form == "console" and hasattr(x, "to_text"):
        return x.to_text()
    return x.to_markdown()


def _run(a) -> int:
    from plumbline.plans import diff, lint, stats
    from plumbline.sources import adapters

    if a.verb in ("lint", "report"):
        if a.checks:
            lint.validate_checks(a.checks)
        lint.load_config(a.config, a.path)
        report = lint.lint_dataset(a.path, a.config, a.checks, a.adapter)
        if a.verb == "lint":
            print(_rendered(report, a.format))
        else:
            forms = {".html": "html", ".json": "json", ".md": "markdown", ".markdown": "markdown"}
            form = forms.get(Path(a.output).suffix.lower())
            if form is None:
                raise ValueError(f"--output must end in {', '.join(forms)}")
            Path(a.output).write_text(_rendered(report, form), encoding="utf-8")
            print(report.summary())
        return int(report.should_fail(a.fail_on))
    if a.verb == "stats":
        if not Path(a.path).is_dir():
            raise ValueError(f"{a.path} is not a folder")
        print(_rendered(stats.compute_dataset_stats(a.path, a.config), a.format))
        return 0
    if a.verb == "diff":
        for x in (a.old, a.new):
            if not Path(x).is_dir():
                raise ValueError(f"{x} is not a folder")
        report = diff.compare_datasets(a.old, a.new, a.config)
        print(_rendered(report, a.format))
        return int(a.fail_on_regression and bool(report.regressions))
    if a.verb == "adapters":
        rows = dict(adapters.detect_adapters(a.path)) if a.path else {n: all(x.values()) for n, x in adapters.available_adapters().items()}
        print(json.dumps(rows, indent=2) if a.format == "json" else "\n".join(f"{n:12} {'yes' if y else 'no'}" for n, y in rows.items()))
        return 0
    options = {"deep": a.deep, "max_rows": a.max_rows, "allow_large_sample": a.allow_large_sample, "split": a.split, "streaming": a.streaming}
    if a.max_rows < 1:
        raise ValueError("--max-rows must be 1 or more")
    if a.verb == "validate":
        try:
            report = adapters.validate_dataset(a.path, a.adapter, **options)
        except adapters.AdapterDependencyError as e:
            name = adapters.select_adapter(a.path, a.adapter).name
            report = adapters.ValidationReport(name, a.path, True, False, errors=[str(e)])
        print(_rendered(report, a.format))
        return int(not report.valid)
    manifest = adapters.load_dataset(a.path, a.adapter, **options)
    if a.verb == "export-manifest":
        Path(a.output).write_text(manifest.to_json(), encoding="utf-8")
        print(a.output)
        return 0
    counts = manifest.counts()
    head = {"dataset_name": manifest.dataset_name, "adapter": manifest.adapter_name, "version": manifest.version, **counts, "limitations": manifest.limitations}
    print(json.dumps(head, indent=2) if a.format == "json" else "\n".join(f"- {k}: {v}" for k, v in head.items()))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    from plumbline.sources.adapters.base import AdapterError

    try:
        return _run(args)
    except (ValueError, OSError, AdapterError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
