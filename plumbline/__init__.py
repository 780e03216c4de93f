"""Dataset validation, profiling and comparison on Spark."""

__version__ = "0.1.0"

_HOMES = {
    "lint_dataset": "plumbline.plans.lint",
    "check_sensor_synchronization": "plumbline.plans.lint",
    "check_label_consistency": "plumbline.plans.lint",
    "compare_datasets": "plumbline.plans.diff",
    "compute_dataset_stats": "plumbline.plans.stats",
    "Issue": "plumbline.plans.report",
    "LintReport": "plumbline.plans.report",
    "LintConfig": "plumbline.config",
    "DatasetStats": "plumbline.plans.stats",
    "DatasetDiffReport": "plumbline.plans.diff",
}


def __getattr__(name: str):
    if name in _HOMES:
        import importlib

        return getattr(importlib.import_module(_HOMES[name]), name)
    raise AttributeError(name)
