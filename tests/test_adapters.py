import json
import shutil
import struct

import pytest
from folders import sound, write

from plumbline.operators import rules
from plumbline.sources import adapters as A
from plumbline.sources.files import Store
from plumbline.sources.manifest import make_manifest

P2 = "P2: 512 0 320 11 0 512 96 0 0 0 1 0.5\n"
LABEL = "Van 0.1 1 -1.5 30 40 90 80 1.9 1.8 4.4 2 1.5 17 0.3\n"
#: A drive of one sample, in the tables of the format.
NU = {
    "sample": [{"token": "dawn", "timestamp": 77_500_000, "scene_token": "pier"}],
    "sample_data": [
        {"token": "shot", "sample_token": "dawn", "calibrated_sensor_token": "lens", "ego_pose_token": "here", "filename": "samples/CAM_LEFT/dawn.jpg", "timestamp": 77_500_000, "channel": "CAM_LEFT"},
        {"token": "sweep", "sample_token": "dawn", "calibrated_sensor_token": "laser", "ego_pose_token": "here", "filename": "samples/LIDAR_ROOF/dawn.bin", "timestamp": 77_540_000, "channel": "LIDAR_ROOF"},
    ],
    "scene": [{"token": "pier", "name": "along the pier"}],
    "calibrated_sensor": [{"token": "lens", "sensor_token": "left", "camera_intrinsic": [[410, 0, 160], [0, 415, 120], [0, 0, 1]]}, {"token": "laser", "sensor_token": "roof", "camera_intrinsic": []}],
    "sensor": [{"token": "left", "channel": "CAM_LEFT", "modality": "camera"}, {"token": "roof", "channel": "LIDAR_ROOF", "modality": "lidar"}],
    "ego_pose": [{"token": "here", "timestamp": 77_500_000}],
    "sample_annotation": [{"token": "crate", "sample_token": "dawn", "category_name": "static.crate", "translation": [4, -2, 0.5], "size": [0.8, 1.2, 1], "rotation": [0, 0, 0, 1]}],
}
LAYOUTS = {
    "generic": {"timestamps.csv": "frame_id,timestamp\nf07,3.5\nf08,4.25\n", "annotations.json": {"annotations": [{"id": "n1", "frame_id": "f08", "category": "crate", "type": "bbox", "bbox": [6, 2, 9, 5]}]}, "images/f07.png": b"p", "images/f08.png": b"p", "labels/notes.txt": "none"},
    "coco": {"annotations/instances_pier.json": {"images": [{"id": 31, "file_name": "gull.png", "width": 64, "height": 48}], "annotations": [{"id": 5, "image_id": 31, "category_id": 12, "bbox": [3, 4, 10, 12]}], "categories": [{"id": 12, "name": "gull"}]}, "images/gull.png": b"p"},
    "kitti": {"image_2/000417.png": b"p", "velodyne/000417.bin": b"p", "label_2/000417.txt": LABEL, "calib/000417.txt": P2},
    "kitti-odometry": {"sequences/04/image_2/000003.png": b"p", "sequences/04/velodyne/000003.bin": b"p", "sequences/04/calib.txt": P2, "sequences/04/times.txt": "0.31\n"},
    "argoverse2": {**{f"quay/sensors/cameras/left_eye/{t}.jpg": b"p" for t in (315_970_000_050_000_000, 315_970_000_150_000_000, 315_970_000_250_000_000)}, "quay/sensors/lidar/315970000060000000.feather": b"p", "quay/annotations.feather": b"p", "quay/calibration/egovehicle.feather": b"p"},
    "lerobot": {"meta/info.json": {"repo_id": "dock/crane", "codebase_version": "v2.1", "splits": {"train": "0:1"}}, "meta/episodes.jsonl": '{"episode_index": 0, "length": 30}\n{half a line\n', "meta/tasks.jsonl": '{"task_index": 0, "task": "lift the crate"}\n', "data/chunk-000/episode_000000.parquet": b"p", "videos/chunk-000/wrist/episode_000000.mp4": b"p"},
    "nuscenes": {**{f"v1.0-mini/{k}.json": v for k, v in NU.items()}, "v1.0-mini/samples/CAM_LEFT/dawn.jpg": b"p", "v1.0-mini/samples/LIDAR_ROOF/dawn.bin": b"p" * 60},
    "waymo": {"drive-77.tfrecord": b"p"},
    "rosbag": {"metadata.yaml": "topics:\n  - topic_metadata:\n      name: /mast/cam\n      type: sensor_msgs/msg/Image\n    message_count: 14\n  - topic_metadata:\n      name: /hull/imu\n      type: sensor_msgs/msg/Imu\n    message_count: 90\n", "run.db3": b"p"},
    "mcap": {"run.mcap": b"p"},
    "huggingface": {"dataset_info.json": {"features": {"photo": {"_type": "Image"}, "species": {"_type": "ClassLabel"}, "remark": {"dtype": "string"}}}, "state.json": {}},
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_detects_and_validates_layouts(spark, tmp_path, layout):
    root = write(tmp_path / "set", LAYOUTS[layout])
    name = layout.split("-")[0]
    assert A.detect_adapter(root).name == name
    report = A.validate_dataset(root, spark=spark)
    assert report.detected and report.valid, report.errors
    doc = json.loads(A.load_dataset(root, spark=spark).to_json())
    assert doc["adapter_name"] == name and doc["sequences"] and doc["provenance"]["root_hash"].startswith("sha256:")
    assert json.loads(report.to_json())["stats"]["sequences_count"] == len(doc["sequences"])


@pytest.mark.parametrize(
    ("layout", "changes", "word"),
    [
        ("generic", {"annotations.json": {"annotations": [{"id": "n1", "frame_id": "f99"}]}}, "unknown frame"),
        ("coco", {"annotations/instances_pier.json": {"images": [{"id": 31, "file_name": "tern.png"}], "annotations": [{"id": 5, "image_id": 32, "category_id": 12, "bbox": [3, 4, 10, 0]}], "categories": []}}, "no area"),
        ("kitti", {"label_2/000417.txt": "Van 0.1 1 -1.5\n", "velodyne/000418.bin": b"p"}, "of 15 fields"),
        ("kitti-odometry", {"sequences/04/times.txt": "0.31\n0.3\n"}, "don't increase"),
        ("nuscenes", {"v1.0-mini/sample_data.json": [NU["sample_data"][0] | {"ego_pose_token": "nowhere", "filename": "gone.jpg"}]}, "unknown ego_pose"),
        ("waymo", {"again/drive-77.tfrecord": b"p"}, "2 times"),
    ],
)
def test_broken_layouts(spark, tmp_path, layout, changes, word):
    report = A.validate_dataset(write(tmp_path / "set", LAYOUTS[layout] | changes), spark=spark)
    assert not report.valid and any(word in e for e in report.errors), report.errors


def test_detection_of_nothing_ambiguity_and_folder(spark, tmp_path):
    with pytest.raises(A.AdapterDetectionError, match="ambiguous"):
        A.detect_adapter(write(tmp_path / "two", {"run.mcap": b"p", "run.bag": b"p"}))
    with pytest.raises(A.AdapterDetectionError):
        A.detect_adapter(write(tmp_path / "none", {"run.xyz": b"p"}))
    with pytest.raises(A.AdapterNotFoundError):
        A.get_adapter("nope")
    root = sound(tmp_path / "folder")
    assert A.detect_adapter(root).name == "folder"
    m = A.load_dataset(root, spark=spark)
    assert m.counts() == {"sequences": 1, "frames": 47, "sensors": 3, "annotations": 9, "calibration": 3, "splits": 0}
    assert m.timestamps("hull_imu").count() == 33


def test_manifest_rules(spark, tmp_path):
    shot = lambda name, t: {"frame_id": name, "sequence_id": "run", "sensor_id": "eye", "timestamp": t, "file_path": "lost.png"}
    rows = {
        "sequences": [{"sequence_id": "run"}],
        "frames": [shot("u", 8.5), shot("v", 9.0), shot("u", 9.0), shot("w", 6.25)],
        "sensors": [{"sensor_id": "eye", "sensor_type": "camera", "frame_count": 9}, {"sensor_id": "spare", "sensor_type": "lidar"}],
        "calibration": [{"sensor_id": "eye", "intrinsic": [[3.0, 0.0, 1.0], [0.0, 3.0, 1.0]]}],
        "splits": [{"split": "val", "frame_id": "z"}],
    }
    m = make_manifest(spark, "x", "kitti", str(tmp_path), rows)
    found = {(r.rule, r.kind) for r in rules.run_rules(m, Store(str(tmp_path), spark).index(spark)).collect()}
    assert found == {("frame_references", "error"), ("sensor_links", "warning"), ("timestamps", "error"), ("timestamps", "warning"), ("calibration", "error"), ("splits", "error")}


def test_deep_modes_with_readers(spark, tmp_path):
    root = write(tmp_path / "m", LAYOUTS["mcap"])
    reader = lambda path: iter([("/camera", "Image", 10**9 * i, None) for i in range(5)])
    m = A.load_dataset(root, spark=spark, deep=True, max_rows=3, reader=reader)
    assert m.frames.count() == 3 and m.metadata["truncated"] and [r.timestamp for r in m.frames.orderBy("ord").collect()] == [0, 1, 2]
    broken = A.validate_dataset(root, spark=spark, deep=True, reader=lambda p: 1 / 0)
    assert not broken.valid and broken.errors[0].startswith("parse error")
    with pytest.raises(A.AdapterDependencyError):
        A.validate_dataset(root, spark=spark, deep=True)
    hf = write(tmp_path / "h", LAYOUTS["huggingface"])
    rows = [{"id": 1, "image": b"x", "bbox": [0, 0, 1]}, {"id": 1, "caption": "x"}]
    report = A.validate_dataset(hf, spark=spark, deep=True, reader=lambda p: iter([{k: v for k, v in r.items() if k != "image"} | ({"image": "x"} if "image" in r else {}) for r in rows]))
    assert any("four numbers" in e for e in report.errors) and any("more than once" in e for e in report.errors)
    with pytest.raises(A.UnsupportedDatasetFeature):
        A.load_dataset(hf, spark=spark, deep=True, max_rows=5000)


def test_readers_of_installed_parsers_run_on_executors(spark, tmp_path, monkeypatch):
    """Stand-ins of the parser packages, on the path of driver and workers."""
    home = tmp_path / "packages"
    write(
        home,
        {
            "mcap/__init__.py": "",
            "mcap/reader.py": "from types import SimpleNamespace as N\nclass R:\n    def __init__(self, f): self.f = f\n    def iter_messages(self):\n        for i, line in enumerate(self.f.read().decode().split()):\n            yield N(name='Image'), N(topic=line), N(log_time=i * 10**9)\ndef make_reader(f): return R(f)\n",
            "rosbags/__init__.py": "",
            "rosbags/highlevel.py": "from types import SimpleNamespace as N\nclass AnyReader:\n    def __init__(self, paths): self.paths = paths\n    def __enter__(self): return self\n    def __exit__(self, *a): pass\n    def messages(self):\n        for i, line in enumerate(self.paths[0].read_text().split()):\n            yield N(topic=line, msgtype='sensor_msgs/Imu'), i * 10**9, b''\n",
            "waymo_open_dataset/__init__.py": "",
            "waymo_open_dataset/dataset_pb2.py": "import json\nfrom types import SimpleNamespace as N\ndef obj(x): return N(**{k: obj(v) for k, v in x.items()}) if isinstance(x, dict) else [obj(y) for y in x] if isinstance(x, list) else x\nclass Frame:\n    def ParseFromString(self, raw): self.__dict__.update(obj(json.loads(raw)).__dict__)\n",
        },
    )
    monkeypatch.syspath_prepend(str(home))
    for name in ("mcap", "rosbags", "waymo_open_dataset"):
        shutil.make_archive(str(tmp_path / name), "zip", home, name)
        spark.sparkContext.addPyFile(str(tmp_path / f"{name}.zip"))
    root = write(tmp_path / "m", {"one.mcap": "/mast/cam /hull/imu /mast/cam", "two.mcap": "/gps"})
    m = A.load_dataset(root, spark=spark, deep=True)
    assert {(r.sensor_id, r.sensor_type, r.frame_count) for r in m.sensors.collect()} == {("/mast/cam", "camera", 2), ("/hull/imu", "camera", 1), ("/gps", "camera", 1)}
    assert {(r.sequence_id, r.frame_count, r.end_time) for r in m.sequences.collect()} == {("one", 3, 2.0), ("two", 1, 0.0)}
    root = write(tmp_path / "r", {"metadata.yaml": LAYOUTS["rosbag"]["metadata.yaml"], "run.db3": "/hull/imu /hull/imu"})
    assert [r.timestamp for r in A.load_dataset(root, spark=spark, deep=True).frames.orderBy("ord").collect()] == [0, 1]
    shot = {
        "timestamp_micros": 77_500_000, "images": [{"name": 1}], "lasers": [{"name": 4}],
        "laser_labels": [{"id": "crate", "type": 2, "box": {"center_x": 4.0, "length": 1.5}}],
        "context": {"camera_calibrations": [{"name": 1, "intrinsic": [410, 415, 160, 120, 0], "extrinsic": {"transform": [*range(16)]}}], "laser_calibrations": [{"name": 4, "extrinsic": {"transform": [*range(16)]}}]},
    }
    raw = b"".join(struct.pack("<Q", len(p)) + b"crc1" + p + b"crc2" for p in (json.dumps(shot | {"timestamp_micros": t}).encode() for t in (77_500_000, 78_500_000)))
    m = A.load_dataset(write(tmp_path / "w", {"drive.tfrecord": raw}), spark=spark, deep=True)
    assert [(r.sensor_id, r.timestamp) for r in m.frames.orderBy("ord").collect()] == [("camera_1", 77.5), ("camera_1", 78.5)]
    assert {(r.annotation_type, r.category) for r in m.annotations.collect()} == {("box3d", "2")} and m.annotations.count() == 2
    rigs = {r.sensor_id: r for r in m.calibration.collect()}
    assert rigs["camera_1"].intrinsic == [[410, 0, 160], [0, 415, 120], [0, 0, 1]] and rigs["lidar_4"].extrinsic[3] == [12, 13, 14, 15]
    torn = A.validate_dataset(write(tmp_path / "t", {"drive.tfrecord": raw[:-2]}), spark=spark, deep=True)
    assert not torn.valid and "ends inside a record" in torn.errors[0]


def test_hub_dataset_without_its_package(spark):
    m = A.load_dataset("hf://pier/gulls", adapter="huggingface", spark=spark, split="train")
    assert [r.sequence_id for r in m.sequences.collect()] == ["train"] and m.metadata["dependency"] == "datasets" and m.limitations
    assert any("datasets" in e for e in A.validate_dataset("hf://pier/gulls", adapter="huggingface", spark=spark).errors)


def test_payload_heads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 64, 48)
    root = write(tmp_path / "n", LAYOUTS["nuscenes"] | {"v1.0-mini/samples/CAM_LEFT/dawn.jpg": png})
    assert A.validate_dataset(root, spark=spark, deep=True).valid
    root = write(tmp_path / "n2", LAYOUTS["nuscenes"] | {"v1.0-mini/samples/LIDAR_ROOF/dawn.bin": b"p" * 61})
    assert any("multiple of 20" in e for e in A.validate_dataset(root, spark=spark, deep=True).errors)


def test_plugins(spark, tmp_path):
    class Own(A.Adapter):
        name = "own"

        def can_load(self, store):
            return store.has("own.txt")

    class Point:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if isinstance(self.value, Exception):
                raise self.value
            return self.value

    errors = A.discover_plugins([Point("a", Own), Point("b", ValueError("broken"))])
    assert A.detect_adapter(write(tmp_path, {"own.txt": "x"})).name == "own" and any("broken" in e for e in errors)
    A._registry.pop("own")
