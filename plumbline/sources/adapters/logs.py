"""Adapters of recorded logs and hub datasets: Waymo, ROS bags, MCAP, Hugging Face.

Without their optional parser packages these index files; with one (or with a
``reader`` given in the options) deep mode reads up to ``max_rows`` messages
over all files together.
"""

from __future__ import annotations

import itertools

from plumbline.sources.adapters import readers
from plumbline.sources.adapters.base import Adapter, AdapterDependencyError, Found, UnsupportedDatasetFeature
from plumbline.sources.adapters.layouts import SPLITS, kind_of, number
from plumbline.sources.manifest import records


def topic_kind(topic: str, schema: str = "") -> str:
    both = f"{topic} {schema}".lower()
    for kind, words in (("camera", ("image", "camera")), ("lidar", ("lidar", "pointcloud", "points")), ("imu", ("imu",)), ("gps", ("gps", "navsat", "gnss"))):
        if any(w in both for w in words):
            return kind
    return "topic"


def _with_extra(read):
    """A reader whose messages may lack the last field."""

    def full(path):
        for message in read(path):
            yield (*message, None)[:4]

    return full


class LogAdapter(Adapter):
    """Files that are one sequence each; deep mode reads (topic, schema, time in ns, extra) messages.

    A reader is called with a file's path, on the executors, and yields such
    tuples; for Waymo the time is in microseconds.
    """

    suffixes: tuple[str, ...] = ()
    parse = None
    kind = "log"
    per_second = 1e9
    not_checked = ("message contents",)

    def units(self, store):
        return [e for e in store.files if e.ext in self.suffixes]

    def can_load(self, store):
        return bool(self.units(store))

    def scope(self, options):
        if options.deep:
            return "bounded deep", [*self.checked, "message times of a bounded sample"], ["payload semantics"]
        return "index-level", list(self.checked), ["message contents", "message times"]

    def open_messages(self, options):
        """The caller's reader, or that of the format if its parser package is installed."""
        if options.reader is not None:
            return options.reader
        if self.parse is not None and all(self.availability().values()):
            return self.parse
        raise AdapterDependencyError(f"deep mode of {self.name} needs a parser package: {', '.join(self.needs)}")

    def find(self, spark, store, options):
        units = self.units(store)
        sequences = [{"sequence_id": e.stem, "name": e.name, "split": next((p for p in e.parts if p in ("train", "training", "val", "validation", "test", "testing", *SPLITS)), None), "metadata": {"file_path": e.rel, "size": e.size}} for e in units]
        if not options.deep:
            return self.indexed(spark, store, units, sequences)
        read = self.open_messages(options)
        # a bounded sample; files are parsed once for all that is asked of it
        every = readers.messages(spark, [(e.rel, e.stem, store.path(e.rel)) for e in units], _with_extra(read), self.per_second, options.max_rows).cache()
        warnings = [r.error for r in every.where("error IS NOT NULL").orderBy("nth").collect()]
        whole = every.where("error IS NULL")
        truncated = whole.count() > options.max_rows
        sample = whole.orderBy("nth", "i").limit(options.max_rows)
        listed = records(spark, "sequences", sequences).drop("frame_count", "start_time", "end_time")
        limits = [f"only the first {options.max_rows} messages were read"] if truncated else []
        return Found(store.root.rsplit("/", 1)[-1], rows=readers.records(sample, listed), metadata={"truncated": truncated}, limitations=limits, warnings=warnings)

    def indexed(self, spark, store, units, sequences):
        return Found(store.root.rsplit("/", 1)[-1], rows={"sequences": sequences}, limitations=[f"{self.kind} files are indexed, not opened"])

    def problems(self, spark, store, m, options):
        units = self.units(store)
        errors = [] if units else [f"no {self.kind} files"]
        return errors, [f"empty file: {e.rel}" for e in units if e.size == 0]


class McapAdapter(LogAdapter):
    name, suffixes, kind, needs = "mcap", (".mcap",), "MCAP", ("mcap",)
    parse = staticmethod(readers.mcap_messages)
    checked = ("files and sizes",)

    def problems(self, spark, store, m, options):
        errors, warnings = super().problems(spark, store, m, options)
        return errors, warnings if options.deep else [*warnings, "channels and schemas are unknown without deep mode"]


class RosbagAdapter(LogAdapter):
    name, suffixes, kind, needs = "rosbag", (".bag", ".db3", ".sqlite3"), "bag", ("rosbags",)
    parse = staticmethod(readers.bag_messages)
    checked = ("files and sizes", "topics of metadata.yaml")

    def can_load(self, store):
        return bool(self.units(store)) or store.has("metadata.yaml")

    def topics(self, store) -> list[tuple[str, str, int | None]]:
        """(topic, type, messages) by lines of metadata.yaml."""
        if not store.has("metadata.yaml"):
            return []
        out: list[list] = []
        for line in store.read_text("metadata.yaml").splitlines():
            key, _, value = line.strip().removeprefix("- ").partition(":")
            value = value.strip().strip("\"'")
            if key == "name" and value:
                out.append([value, "", None])
            elif out and key == "type":
                out[-1][1] = value
            elif out and key == "message_count" and value.isdigit():
                out[-1][2] = int(value)
        return [tuple(x) for x in out]

    def indexed(self, spark, store, units, sequences):
        found = super().indexed(spark, store, units, sequences)
        found.rows["sensors"] = [{"sensor_id": t, "sensor_type": topic_kind(t, s), "name": t, "modality": topic_kind(t, s), "frequency_hz": None, "frame_count": n, "metadata": {"type": s}} for t, s, n in self.topics(store)]
        return found

    def problems(self, spark, store, m, options):
        errors, warnings = super().problems(spark, store, m, options)
        if any(e.ext in (".db3", ".sqlite3") for e in self.units(store)) and not store.has("metadata.yaml"):
            warnings.append("database without metadata.yaml")
        if m.sensors.isEmpty():
            warnings.append("no topics known")
        return errors, warnings


class WaymoAdapter(LogAdapter):
    name, suffixes, kind, needs, per_second = "waymo", (".tfrecord", ".tfrecords"), "TFRecord", ("waymo_open_dataset",), 1e6
    parse = staticmethod(readers.waymo_messages)
    checked = ("files and sizes", "segment names")

    def indexed(self, spark, store, units, sequences):
        found = super().indexed(spark, store, units, sequences)
        mark = {"indexed_tfrecord": True}
        found.rows["frames"] = [{"frame_id": e.stem, "sequence_id": e.stem, "sensor_id": "tfrecord", "file_path": e.rel, "metadata": mark} for e in units]
        found.rows["sensors"] = [{"sensor_id": "tfrecord", "sensor_type": "container", "name": "tfrecord", "frame_count": len(units), "metadata": mark}] if units else []
        return found

    def problems(self, spark, store, m, options):
        errors, warnings = super().problems(spark, store, m, options)
        stems = [e.stem for e in self.units(store)]
        errors += [f"segment name occurs {stems.count(s)} times: {s}" for s in sorted({s for s in stems if stems.count(s) > 1})]
        if options.deep and m.frames.isEmpty():
            warnings.append("no frames were read")
        return errors, warnings


class HuggingFaceAdapter(Adapter):
    name, needs = "huggingface", ("datasets",)
    checked = ("features", "splits", "row ids and boxes of a bounded sample in deep mode")
    SAMPLE_CAP = 1000

    def can_load(self, store):
        return store.root.startswith("hf://") or store.has("dataset_info.json") or store.has("state.json")

    def _features(self, info: dict) -> dict[str, str]:
        out = {}
        for name, f in (info.get("features") or {}).items():
            f = f if isinstance(f, dict) else {}
            out[name] = {"Image": "image", "Audio": "audio", "Video": "video", "ClassLabel": "label", "Sequence": "sequence"}.get(f.get("_type"), f.get("dtype") or "value")
        return out

    def find(self, spark, store, options):
        if options.max_rows > self.SAMPLE_CAP and options.deep and not options.allow_large_sample:
            raise UnsupportedDatasetFeature(f"samples of over {self.SAMPLE_CAP} rows need allow_large_sample")
        info = store.json_object("dataset_info.json") if store.entries else {}
        features = self._features(info)
        name = info.get("dataset_name") or store.root.removeprefix("hf://").rsplit("/", 1)[-1]
        kinds = {"image": "camera", "audio": "audio", "video": "camera"}
        sensors = [{"sensor_id": f, "sensor_type": kinds[k], "name": f, "modality": k} for f, k in features.items() if k in kinds]
        splits = list(info.get("splits") or {}) or ([options.split] if options.split else [])
        sequences = [{"sequence_id": s, "name": s, "split": s} for s in splits or ["default"]]
        remote = not store.entries
        if remote and options.reader is None and not all(self.availability().values()):
            note = "rows and features of a hub dataset need the package: datasets"
            missing = {"dependency": "datasets", "split": options.split, "streaming": options.streaming, "remote": True}
            return Found(name, None, {"sequences": sequences}, missing, [note], [note])
        if not options.deep:
            limits = ["nothing was fetched"] if remote else ["rows are not read"]
            return Found(name, info.get("version") if isinstance(info.get("version"), str) else None, {"sequences": sequences, "sensors": sensors}, {"features": features, "remote": remote}, limits)
        rows, truncated = self._rows(spark, store, options)
        frames, notes = [], []
        for i, r in enumerate(rows):
            rid = str(next((r[k] for k in ("id", "image_id", "sample_id") if r.get(k) is not None), i))
            sensor = next((k for k, v in features.items() if v in kinds and r.get(k) is not None), None) or next((k for k in r if kind_of(k) == "camera"), None)
            frames.append({"frame_id": rid, "sequence_id": sequences[0]["sequence_id"], "timestamp": number(r.get("timestamp")), "sensor_id": sensor, "metadata": {"has_payload": sensor is not None}})
            for k, v in r.items():
                if k in ("label", "labels", "category", "bbox", "bboxes", "caption", "objects"):
                    notes.append({"annotation_id": f"{rid}:{k}", "frame_id": rid, "sequence_id": sequences[0]["sequence_id"], "category": str(v) if k in ("label", "category") else None, "annotation_type": k, "values": {k: v}})
        seen = {f["sensor_id"] for f in frames if f["sensor_id"]}
        sensors += [{"sensor_id": s, "sensor_type": "camera", "name": s} for s in sorted(seen - {s["sensor_id"] for s in sensors})]
        limits = [f"only the first {options.max_rows} rows were read"] if truncated else []
        return Found(name, None, {"sequences": sequences, "frames": frames, "sensors": sensors, "annotations": notes}, {"features": features, "remote": False}, limits)

    def _loaded(self, store, options):
        """Rows by the package: of a saved folder, or of the hub, streamed if asked for."""
        import datasets

        if store.entries:
            saved = datasets.load_from_disk(store.root)
            return saved[options.split or next(iter(saved))] if hasattr(saved, "keys") else saved
        name = store.root.removeprefix("hf://")
        found = datasets.load_dataset(name, split=options.split, streaming=options.streaming)
        return found[next(iter(found))] if hasattr(found, "keys") else found

    def _rows(self, spark, store, options):
        if options.reader is not None:
            got = list(itertools.islice(options.reader(store.root), options.max_rows + 1))
        elif data := [store.path(e.rel) for e in store.files if e.ext == ".parquet"]:
            got = [r.asDict(recursive=True) for r in spark.read.parquet(*data).limit(options.max_rows + 1).collect()]
        elif all(self.availability().values()):
            got = [dict(r) for r in itertools.islice(self._loaded(store, options), options.max_rows + 1)]
        else:
            raise AdapterDependencyError("rows of this dataset need the package: datasets")
        return got[: options.max_rows], len(got) > options.max_rows

    def problems(self, spark, store, m, options):
        errors, warnings = [], []
        if m.metadata.get("remote") and not all(self.availability().values()):
            errors.append("the package datasets isn't installed")
        if m.sequences.isEmpty():
            errors.append("no splits")
        if m.sensors.isEmpty():
            warnings.append("no image, audio or video feature")
        if options.deep:
            import json

            for r in m.annotations.where("annotation_type = 'bbox'").orderBy("ord").collect():
                box = json.loads(r["values"])["bbox"]
                if not (isinstance(box, list) and len(box) == 4 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in box)):
                    errors.append(f"bbox of row {r.frame_id} isn't four numbers")
            bare = m.frames.where("sensor_id IS NULL").count()
            if bare:
                warnings.append(f"{bare} rows have no image, audio or video")
        return errors, warnings


