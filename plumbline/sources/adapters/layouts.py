"""Adapters of layouts that are indexed from files: folder, generic, KITTI, Argoverse 2, LeRobot."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import functions as F

from plumbline.config import LintConfig
from plumbline.functions import exprs as X
from plumbline.operators import kernels as K
from plumbline.sources.adapters.base import Adapter, Found, sensors_of, sequences_of
from plumbline.sources.bundle import load_bundle


# fixed sets of file kinds
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv")
CLOUDS = (".pcd", ".bin", ".ply")
TEXTS = (".json", ".jsonl", ".csv", ".txt", ".yaml", ".yml")
SPLITS = ("train", "val", "test")


def number(x):
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return v if v == v else None


def kind_of(name: str) -> str:
    low = name.lower()
    return next((k for k, words in (("camera", ("cam", "image", "rgb")), ("lidar", ("lidar", "velodyne", "points")), ("radar", ("radar",)), ("imu", ("imu",)), ("gps", ("gps",))) if any(w in low for w in words)), "other")


class FolderAdapter(Adapter):
    name = "folder"
    mode = "full lint"
    checked = ("all folder checks by lint", "manifest links, timestamps and splits")
    not_checked = ("image contents",)

    def can_load(self, store):
        return not store.single_file and (store.has("metadata.json") or store.has("sensors") or store.has("trajectories"))

    def find(self, spark, store, options):
        b = load_bundle(spark, store.root, LintConfig())
        name = (b.metadata or {}).get("dataset_name") or store.root.rsplit("/", 1)[-1]
        rows: dict = {"sequences": [{"sequence_id": "dataset", "name": name}]}
        if (df := b.frames.get("sensors")) is not None:
            has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
            rows["frames"] = df.select(
                F.concat_ws(":", "stream", F.col("row").cast("string")).alias("frame_id"),
                F.lit("dataset").alias("sequence_id"),
                F.col("ts").alias("timestamp"),
                F.col("stream").alias("sensor_id"),
                X.text_or_null(has("path")).alias("file_path"),
                has("width").try_cast("int").alias("width"),
                has("height").try_cast("int").alias("height"),
                F.xxhash64("stream").bitwiseAND(F.lit((1 << 30) - 1)).alias("__s"),
                "row",
            ).withColumn("ord", F.shiftleft("__s", 32) + F.col("row"))
            counts = df.groupBy("stream").agg(F.count(F.lit(1)).alias("frame_count"))
            rates = K.timings(df, ["stream"]).select("stream", F.col("inferred_frequency_hz").alias("frequency_hz"))
            rows["sensors"] = counts.join(rates, "stream", "left").select(F.col("stream").alias("sensor_id"), X.sensor_kind(F.col("stream")).alias("sensor_type"), F.col("stream").alias("name"), X.sensor_kind(F.col("stream")).alias("modality"), "frequency_hz", "frame_count", F.lit(0).alias("ord"))
        if (df := b.frames.get("labels")) is not None:
            rows["annotations"] = df.select(
                F.concat_ws(":", "stream", F.col("row").cast("string")).alias("annotation_id"),
                F.lit("dataset").alias("sequence_id"),
                (X.text_or_null("class") if "class" in df.columns else F.lit(None)).alias("category"),
                F.lit("bbox_2d").alias("annotation_type"),
                F.to_json(F.struct(*[c for c in ("timestamp", "track_id", "x", "y", "width", "height", "confidence") if c in df.columns])).alias("values"),
                F.col("row").alias("ord"),
            )
        rows["calibration"] = [{"sensor_id": s, "intrinsic": e.get("intrinsics") if _numbers(e.get("intrinsics")) else None, "metadata": {"extrinsics": e.get("extrinsics")}} for s, e in (b.calibration or {}).items() if isinstance(e, dict)]
        return Found(name, (b.metadata or {}).get("version"), rows, b.metadata or {}, warnings=[f["message"] for f in b.load_findings])


def _numbers(m) -> bool:
    return isinstance(m, list) and all(isinstance(r, list) and all(isinstance(x, int | float) for x in r) for r in m)


class GenericAdapter(Adapter):
    name = "generic"
    checked = ("files by kind", "timestamps.csv", "annotation links", "duplicate names")

    def can_load(self, store):
        if store.single_file:
            return False
        known = (*IMAGES, *VIDEOS, *CLOUDS, *TEXTS)
        return any(e.ext in known for e in store.files) or any(store.has(d) for d in (*SPLITS, "videos"))

    def find(self, spark, store, options):
        media = [e for e in store.files if e.ext in (*IMAGES, *VIDEOS, *CLOUDS) and not any(p.startswith(".") for p in e.parts)]
        times = self._times(store)
        frames, splits = [], []
        for e in media:
            kind = "camera" if e.ext in (*IMAGES, *VIDEOS) else "lidar"
            sensor = next((p for p in reversed(e.parts[:-1]) if p.lower() not in (*SPLITS, "data", "images", "videos")), {"camera": "camera", "lidar": "lidar"}[kind])
            stamp = next((times[k] for k in (e.rel, e.name, e.stem) if times.get(k) is not None), None)
            frames.append({"frame_id": e.rel, "sequence_id": "dataset", "timestamp": stamp, "sensor_id": sensor, "file_path": e.rel, "metadata": {"kind": kind}})
            if e.parts[0] in SPLITS:
                splits.append({"split": e.parts[0], "frame_id": e.rel})
        kinds = {f["sensor_id"]: f["metadata"]["kind"] for f in frames}
        rows = {"frames": frames, "sequences": sequences_of(frames), "sensors": sensors_of(frames, kinds), "splits": splits, "annotations": self._annotations(store, frames)}
        return Found(store.root.rsplit("/", 1)[-1], rows=rows, metadata={"timestamp_rows": len(times)})

    def _times(self, store) -> dict[str, float | None]:
        if not store.has("timestamps.csv"):
            return {}
        out = {}
        for r in csv.DictReader(io.StringIO(store.read_text("timestamps.csv"))):
            key = next((r[c] for c in ("frame_id", "file_path", "path", "filename", "file", "name") if r.get(c)), None)
            if key:
                out[key] = number(r.get("timestamp"))
        return out

    def _annotations(self, store, frames) -> list[dict]:
        by_name = {k: f["frame_id"] for f in frames for k in (f["frame_id"], f["frame_id"].rsplit("/", 1)[-1], f["frame_id"].rsplit("/", 1)[-1].rsplit(".", 1)[0])}
        if store.has("annotations.json"):
            try:
                doc = store.read_json("annotations.json")
            except ValueError:
                return []
            items = doc.get("annotations", []) if isinstance(doc, dict) else doc if isinstance(doc, list) else []
            out = []
            for i, a in enumerate(x for x in items if isinstance(x, dict)):
                ref = next((str(a[k]) for k in ("file_path", "frame_id", "image") if a.get(k) is not None), None)
                out.append({"annotation_id": str(a.get("id", i)), "frame_id": by_name.get(ref, ref), "category": a.get("category"), "annotation_type": a.get("type") or "unknown", "values": {k: v for k, v in a.items() if k in ("bbox", "polygon", "mask", "value")}})
            return out
        return [{"annotation_id": e.rel, "frame_id": by_name.get(e.stem), "annotation_type": "label_file", "metadata": {"file_path": e.rel}} for e in store.files if e.parts[0] == "labels" and e.ext in TEXTS]

    def problems(self, spark, store, m, options):
        frames = m.frames.count()
        errors = [] if frames else ["the dataset has no media files"]
        warnings = []
        if frames and m.annotations.isEmpty():
            warnings.append("frames have no annotations")
        warnings += [f"file name is used {r.n} times: {r.key}" for r in K.repeated_keys(m.frames, X.basename(F.col("file_path"))).orderBy("key").collect()]
        n = m.metadata["timestamp_rows"]
        if n and n != frames:
            warnings.append(f"timestamps.csv has {n} rows for {frames} frames")
        return errors, warnings


class KittiAdapter(Adapter):
    name = "kitti"
    checked = ("image, lidar and label pairing", "label rows", "times", "calibration files")

    def can_load(self, store):
        return store.has("image_2") or store.has("velodyne") or bool(self._sequences(store))

    def _sequences(self, store) -> list[str]:
        return sorted({e.parts[1] for e in store.entries if len(e.parts) >= 3 and e.parts[0] == "sequences" and e.parts[2].startswith("image_")})

    def find(self, spark, store, options):
        odometry = self._sequences(store)
        frames, notes, labels, cal = [], [], [], []
        for seq, at in [(s, f"sequences/{s}/") for s in odometry] or [("object", "")]:
            times = self._times(store, f"{at}times.txt")
            for sensor, kind, exts in (("image_0", "camera", IMAGES), ("image_1", "camera", IMAGES), ("image_2", "camera", IMAGES), ("image_3", "camera", IMAGES), ("velodyne", "lidar", (".bin",))):
                found = [e for e in store.files if e.rel.startswith(f"{at}{sensor}/") and e.ext in exts]
                frames += [{"frame_id": f"{seq}:{sensor}:{e.stem}" if odometry else f"{sensor}:{e.stem}", "sequence_id": seq, "timestamp": times[i] if i < len(times) else None, "sensor_id": sensor, "file_path": e.rel, "metadata": {"logical_id": e.stem, "kind": kind}} for i, e in enumerate(found)]
        if not odometry:
            for e in store.match("label_2/*.txt"):
                labels.append(e.stem)
                for i, line in enumerate(store.read_text(e.rel).splitlines()):
                    p = line.split()
                    if p:
                        notes.append({"annotation_id": f"{e.stem}:{i}", "frame_id": f"image_2:{e.stem}", "sequence_id": "object", "category": p[0], "annotation_type": "kitti_object", "values": {"bbox": [number(x) for x in p[4:8]], "dimensions": [number(x) for x in p[8:11]], "location": [number(x) for x in p[11:14]]} if len(p) >= 15 else {}, "metadata": {"fields": len(p)}})
        for e in store.files:
            if e.name == "calib.txt" or len(e.parts) >= 2 and e.parts[-2] == "calib" and e.ext == ".txt":
                for line in store.read_text(e.rel).splitlines():
                    key, _, rest = line.partition(":")
                    v = [number(x) for x in rest.split()]
                    if key.strip() == "P2" and len(v) == 12 and None not in v:
                        # one file each sequence or frame: the sensors they stand for are the same
                        cal += [{"sensor_id": "image_2", "target_sensor_id": "velodyne", "intrinsic": [v[0:3], v[4:7], v[8:11]], "metadata": {"file_path": e.rel}}]
        kinds = {f["sensor_id"]: f["metadata"]["kind"] for f in frames}
        rows = {"frames": frames, "sequences": sequences_of(frames), "sensors": sensors_of(frames, kinds), "annotations": notes, "calibration": cal}
        return Found(store.root.rsplit("/", 1)[-1], rows=rows, metadata={"layout": "odometry" if odometry else "object", "labels": labels})

    def _times(self, store, rel) -> list[float]:
        return [t for x in store.read_text(rel).split() if (t := number(x)) is not None] if store.has(rel) else []

    def problems(self, spark, store, m, options):
        errors, warnings = [], []
        ids = m.frames.select("sequence_id", "sensor_id", F.get_json_object("metadata", "$.logical_id").alias("id"))
        key = F.concat_ws("/", "sequence_id", "id").alias("key")
        images, clouds = ids.where("sensor_id = 'image_2'").select(key), ids.where("sensor_id = 'velodyne'").select(key)
        if not images.isEmpty() and not clouds.isEmpty():
            for r in K.one_sided(images, clouds, "key").orderBy("key").collect():
                (warnings if r.side == "left" else errors).append(f"image without lidar: {r.key}" if r.side == "left" else f"lidar without image: {r.key}")
        if m.metadata["layout"] == "object" and m.metadata["labels"]:
            have = spark.createDataFrame([(f"object/{x}",) for x in m.metadata["labels"]], "key string")
            warnings += [f"image without labels: {r.key}" for r in K.broken_links(images, "key", have, "key").orderBy("key").collect()]
        if m.calibration.isEmpty():
            warnings.append("no calibration found")
        short = m.annotations.where(F.get_json_object("metadata", "$.fields").cast("int") < 15).orderBy("ord")
        errors += [f"label row has {json.loads(r.metadata)['fields']} of 15 fields: {r.annotation_id}" for r in short.collect()]
        for seq in self._sequences(store):
            times = self._times(store, f"sequences/{seq}/times.txt")
            n = ids.where((F.col("sequence_id") == seq) & (F.col("sensor_id") == "image_2")).count()
            if any(a >= b for a, b in zip(times, times[1:], strict=False)):
                errors.append(f"times of sequence {seq} don't increase")
            if times and n and len(times) != n:
                warnings.append(f"sequence {seq} has {len(times)} times for {n} images")
        return errors, warnings


class ArgoverseAdapter(Adapter):
    name = "argoverse2"
    checked = ("logs, sensor files and their times", "calibration folders")
    limitations = ["feather tables are indexed, not read"]

    def _log(self, store, at: str) -> bool:
        return any(store.has(f"{at}{x}") for x in ("sensors/cameras", "sensors/lidar", "annotations.feather", "calibration")) or any(e.rel.startswith(at) and e.name.startswith("scenario") and e.ext == ".parquet" and len(e.parts) == at.count("/") + 1 for e in store.files) or store.has(f"{at}map") and any(e.rel.startswith(at) and e.ext == ".json" for e in store.files)

    def logs(self, store) -> list[tuple[str, str, str | None]]:
        """(log id, path prefix, split)."""
        if store.single_file:
            return []
        if self._log(store, ""):
            return [(store.root.rsplit("/", 1)[-1], "", None)]
        dirs = [e for e in store.entries if e.is_dir]
        one = [(e.rel, f"{e.rel}/", None) for e in dirs if len(e.parts) == 1 and e.rel not in SPLITS]
        two = [(e.parts[1], f"{e.rel}/", e.parts[0]) for e in dirs if len(e.parts) == 2 and e.parts[0] in SPLITS]
        return [x for x in one + two if self._log(store, x[1])]

    def can_load(self, store):
        if any(store.has(x) for x in ("sensors/gps.csv", "metadata.json")):
            return False
        return bool(self.logs(store))

    def find(self, spark, store, options):
        frames, notes, cal, splits, of = [], [], [], [], {}
        for log, at, split in self.logs(store):
            of[log] = split
            files = [e for e in store.files if e.rel.startswith(f"{at}sensors/")]
            stamps = [int(e.stem) for e in files if e.stem.isdigit()]
            origin = min(stamps, default=0)
            for e in files:
                sub = e.parts[at.count("/") + 1 :]
                sensor = sub[1] if sub[0] == "cameras" and len(sub) > 2 else sub[0]
                # whole nanoseconds from the log's first, then seconds
                t = int(e.stem) if e.stem.isdigit() else None
                stamp = None if t is None else (t - origin) / 1e9 if max(stamps) > 10**12 else float(t)
                frames.append({"frame_id": f"{log}:{sensor}:{e.stem}", "sequence_id": log, "timestamp": stamp, "sensor_id": sensor, "file_path": e.rel, "metadata": {"kind": "camera" if sub[0] == "cameras" else "lidar"}})
                if split:
                    splits.append({"split": split, "frame_id": f"{log}:{sensor}:{e.stem}"})
            if store.has(f"{at}annotations.feather"):
                notes.append({"annotation_id": f"{log}:annotations", "sequence_id": log, "annotation_type": "feather_table", "metadata": {"file_path": f"{at}annotations.feather"}})
            if any(e.rel.startswith(f"{at}calibration/") for e in store.files):
                cal += [{"sensor_id": s, "metadata": {"log": log}} for s in dict.fromkeys(f["sensor_id"] for f in frames if f["sequence_id"] == log)]
        kinds = {f["sensor_id"]: f["metadata"]["kind"] for f in frames}
        rows = {"frames": frames, "sequences": sequences_of(frames, of), "sensors": sensors_of(frames, kinds), "annotations": notes, "calibration": list({c["sensor_id"]: c for c in cal}.values()), "splits": splits}
        known = {s["sequence_id"] for s in rows["sequences"]}
        rows["sequences"] += [{"sequence_id": log, "name": log, "split": s, "frame_count": 0} for log, s in of.items() if log not in known]
        return Found(store.root.rsplit("/", 1)[-1], rows=rows, limitations=list(self.limitations))

    def problems(self, spark, store, m, options):
        errors = ["no logs found"] if m.sequences.isEmpty() else []
        return errors, ["frames have no calibration"] if m.calibration.isEmpty() and not m.frames.isEmpty() else []


class LeRobotAdapter(Adapter):
    name = "lerobot"
    checked = ("meta files", "episode and video pairing", "split ranges")

    def can_load(self, store):
        return any(store.has(x) for x in ("meta/info.json", "meta/episodes.jsonl")) or any(e.parts[0] == "data" and e.ext == ".parquet" for e in store.files)

    def _id(self, stem: str) -> str:
        return stem.removeprefix("episode_")

    def find(self, spark, store, options):
        info = store.json_object("meta/info.json")
        episodes = {str(x.get("episode_index")).zfill(6): x for x in store.json_lines("meta/episodes.jsonl") if x.get("episode_index") is not None}
        data = [e for e in store.files if e.parts[0] == "data" and e.ext in (".parquet", ".jsonl")]
        videos = [e for e in store.files if e.parts[0] == "videos" and e.ext in VIDEOS]
        frames = [{"frame_id": f"{self._id(e.stem)}:data", "sequence_id": self._id(e.stem), "sensor_id": "episode_data", "file_path": e.rel, "metadata": {"kind": "table"}} for e in data]
        frames += [{"frame_id": f"{self._id(e.stem)}:{e.parts[-2]}", "sequence_id": self._id(e.stem), "sensor_id": e.parts[-2], "file_path": e.rel, "metadata": {"kind": "camera"}} for e in videos]
        ids = dict.fromkeys([*(f["sequence_id"] for f in frames), *episodes])
        sequences = [{"sequence_id": i, "name": f"episode {i}", "frame_count": (episodes.get(i) or episodes.get(i.zfill(6)) or {}).get("length")} for i in ids]
        tasks = [{"annotation_id": f"task:{t.get('task_index', i)}", "category": t.get("task"), "annotation_type": "task"} for i, t in enumerate(store.json_lines("meta/tasks.jsonl"))]
        by_episode: dict[str, list[str]] = {}
        for f in frames:
            by_episode.setdefault(f["sequence_id"], []).append(f["frame_id"])
        splits = [{"split": s, "frame_id": fid} for s, v in (info.get("splits") or {}).items() for i in self._episodes(v) for fid in by_episode.get(i, [f"{i}:data"])]
        rows = {"frames": frames, "sequences": sequences, "sensors": sensors_of(frames, {f["sensor_id"]: f["metadata"]["kind"] for f in frames}), "annotations": tasks, "splits": splits}
        return Found(str(info.get("repo_id") or store.root.rsplit("/", 1)[-1]), info.get("codebase_version"), rows, {"has_info": bool(info)}, ["payloads are indexed, not read"])

    def _episodes(self, value) -> list[str]:
        if isinstance(value, str):
            a, colon, b = value.partition(":")
            if colon:
                lo, hi = number(a or 0), number(b)
                return [str(i).zfill(6) for i in range(int(lo), int(hi))] if lo is not None and hi is not None else []
            value = [value]
        return [str(v).zfill(6) for v in value] if isinstance(value, list) else []

    def problems(self, spark, store, m, options):
        errors, warnings = [], [] if m.metadata["has_info"] else ["meta/info.json is missing"]
        if m.frames.isEmpty():
            errors.append("no episode data or videos found")
        data = m.frames.where("sensor_id = 'episode_data'").select("sequence_id")
        videos = m.frames.where("sensor_id <> 'episode_data'").select("sequence_id")
        if not videos.isEmpty():
            warnings += [f"episode without video: {r.sequence_id}" for r in K.one_sided(data, videos, "sequence_id").where("side = 'left'").orderBy("sequence_id").collect()]
        return errors, warnings


