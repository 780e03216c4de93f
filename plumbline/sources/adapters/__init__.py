"""Registry of adapters: detection, lookup and plug-ins."""

from __future__ import annotations

from importlib.metadata import entry_points

from pyspark.sql import SparkSession

from plumbline.session import session
from plumbline.sources.adapters.base import Adapter, AdapterDependencyError, AdapterDetectionError, AdapterError, AdapterNotFoundError, AdapterValidationError, Options, UnsupportedDatasetFeature, ValidationReport
from plumbline.sources.adapters.layouts import ArgoverseAdapter, FolderAdapter, GenericAdapter, KittiAdapter, LeRobotAdapter
from plumbline.sources.adapters.logs import HuggingFaceAdapter, McapAdapter, RosbagAdapter, WaymoAdapter
from plumbline.sources.adapters.tables import CocoAdapter, NuScenesAdapter
from plumbline.sources.files import Store
from plumbline.sources.manifest import Manifest

ENTRY_POINTS = "plumbline.adapters"
#: These load almost any folder, so they stand back if a format of its own matches.
FALLBACKS = ("folder", "generic")
_registry: dict[str, Adapter] = {}
_plugins_found = False
_plugin_errors: list[str] = []

__all__ = ["Adapter", "AdapterDependencyError", "AdapterDetectionError", "AdapterError", "AdapterNotFoundError", "AdapterValidationError", "Options", "UnsupportedDatasetFeature", "ValidationReport"]


def register_adapter(adapter: Adapter) -> None:
    if not adapter.name or not isinstance(adapter, Adapter):
        raise AdapterError("an adapter needs a name and the Adapter base")
    _registry[adapter.name] = adapter


for _a in (FolderAdapter, GenericAdapter, CocoAdapter, KittiAdapter, ArgoverseAdapter, LeRobotAdapter, NuScenesAdapter, WaymoAdapter, RosbagAdapter, McapAdapter, HuggingFaceAdapter):
    register_adapter(_a())


def _made(x) -> list[Adapter]:
    if isinstance(x, type) and issubclass(x, Adapter):
        return [x()]
    if isinstance(x, Adapter):
        return [x]
    if isinstance(x, list | tuple):
        return [a for y in x for a in _made(y)]
    if callable(x):
        return _made(x())
    raise AdapterError(f"{x!r} makes no adapter")


def discover_plugins(found=None) -> list[str]:
    """Register adapters of installed plug-ins, once; failures are kept, not raised."""
    global _plugins_found
    if _plugins_found and found is None:
        return _plugin_errors
    _plugins_found = True
    for point in entry_points(group=ENTRY_POINTS) if found is None else found:
        try:
            for a in _made(point.load()):
                register_adapter(a)
        except Exception as e:  # noqa: BLE001  a broken plug-in must not stop the others
            _plugin_errors.append(f"{point.name}: {e}")
    return _plugin_errors


def list_adapters() -> list[str]:
    discover_plugins()
    return list(_registry)


def available_adapters() -> dict[str, dict[str, bool]]:
    return {n: _registry[n].availability() for n in list_adapters()}


def get_adapter(name: str) -> Adapter:
    if name not in list_adapters():
        raise AdapterNotFoundError(f"unknown adapter {name}; known: {', '.join(_registry)}")
    return _registry[name]


def detect_adapters(root: str, spark: SparkSession | None = None) -> list[tuple[str, bool]]:
    store = Store(root, spark)
    return [(n, bool(_registry[n].can_load(store))) for n in list_adapters()]


def detect_adapter(root: str, spark: SparkSession | None = None) -> Adapter:
    """The one format that matches; folder, then generic, if none of its own does."""
    hits = [n for n, yes in detect_adapters(root, spark) if yes]
    own = [n for n in hits if n not in FALLBACKS]
    if len(own) > 1:
        raise AdapterDetectionError(f"ambiguous: {root} looks like {', '.join(own)}; name the adapter")
    name = next(iter(own), next((f for f in FALLBACKS if f in hits), None))
    if name is None:
        raise AdapterDetectionError(f"no adapter matches {root}")
    return _registry[name]


def select_adapter(root: str, name: str | None = None, spark: SparkSession | None = None) -> Adapter:
    return detect_adapter(root, spark) if name in (None, "auto") else get_adapter(name)


def load_dataset(root: str, adapter: str | None = None, spark: SparkSession | None = None, **options) -> Manifest:
    spark = spark or session()
    return select_adapter(root, adapter, spark).load(root, spark, Options(**options))


def validate_dataset(root: str, adapter: str | None = None, spark: SparkSession | None = None, **options) -> ValidationReport:
    spark = spark or session()
    return select_adapter(root, adapter, spark).validate(root, spark, Options(**options))
