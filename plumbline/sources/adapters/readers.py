"""Messages of recorded logs, read where the executors are.

A reader takes a file's path and yields (topic, schema, time, extra); ``extra``
is None or a dict of ``annotations`` and ``calibration`` records.  The readers
below need the parser package of their format; :func:`messages` runs one of
them, or a caller's own, a file a task, and stops each file after ``max_rows``.
"""

from __future__ import annotations

import itertools
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.session import ship_package


def mcap_messages(path: str):
    from mcap.reader import make_reader

    with open(path, "rb") as f:
        for schema, channel, message in make_reader(f).iter_messages():
            logged = getattr(message, "log_time", None)
            yield channel.topic, getattr(schema, "name", None), getattr(message, "publish_time", None) if logged is None else logged, None


def bag_messages(path: str):
    from pathlib import Path

    from rosbags.highlevel import AnyReader

    with AnyReader([Path(path)]) as bag:
        for connection, time, _ in bag.messages():
            yield connection.topic, connection.msgtype, time, None


def tf_records(path: str):
    """Payloads of a TFRecord file: length, its checksum, payload, checksum."""
    with open(path, "rb") as f:
        while head := f.read(12):
            if len(head) < 12:
                raise ValueError("file ends inside a record")
            (size,) = struct.unpack("<Q", head[:8])
            payload = f.read(size)
            if len(payload) < size or len(f.read(4)) < 4:
                raise ValueError("file ends inside a record")
            yield payload


def _square(values, n: int) -> list[list[float]] | None:
    v = [float(x) for x in values]
    return [v[i : i + n] for i in range(0, n * n, n)] if len(v) >= n * n else None


def _lens(values) -> list[list[float]] | None:
    """Focal lengths and centre, the first four numbers, as a 3x3 matrix."""
    v = [float(x) for x in values]
    return [[v[0], 0.0, v[2]], [0.0, v[1], v[3]], [0.0, 0.0, 1.0]] if len(v) >= 4 else None


def waymo_messages(path: str):
    """A message a frame, with its laser labels and the calibration of its context."""
    from waymo_open_dataset import dataset_pb2

    for payload in tf_records(path):
        frame = dataset_pb2.Frame()
        frame.ParseFromString(payload)
        cameras, lasers = [f"camera_{x.name}" for x in frame.images], [f"lidar_{x.name}" for x in frame.lasers]
        notes = [{"id": x.id, "category": str(x.type), "type": "box3d", "values": json.dumps({k: getattr(x.box, k, None) for k in ("center_x", "center_y", "center_z", "length", "width", "height", "heading")})} for x in frame.laser_labels]
        rigs = [{"sensor_id": f"camera_{x.name}", "intrinsic": _lens(x.intrinsic), "extrinsic": _square(x.extrinsic.transform, 4)} for x in frame.context.camera_calibrations]
        rigs += [{"sensor_id": f"lidar_{x.name}", "intrinsic": None, "extrinsic": _square(x.extrinsic.transform, 4)} for x in frame.context.laser_calibrations]
        yield next(iter([*cameras, *lasers]), "frame"), "Frame", frame.timestamp_micros, {"annotations": notes, "calibration": rigs}


_MESSAGE = """nth bigint, i bigint, rel string, stem string, topic string, schema string, time double,
  annotations array<struct<id:string,category:string,type:string,values:string>>,
  calibration array<struct<sensor_id:string,intrinsic:array<array<double>>,extrinsic:array<array<double>>>>, error string"""


def messages(spark: SparkSession, files: list[tuple[str, str, str]], read, per_second: float, max_rows: int) -> DataFrame:
    """Messages of (rel, stem, path) files in seconds, at most ``max_rows`` + 1 a file; a file that can't be read gives one row with ``error``."""
    ship_package(spark)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples():
                out, error = [], None
                try:
                    for i, (topic, schema, time, extra) in enumerate(itertools.islice(read(r.path.removeprefix("file://")), max_rows + 1)):
                        try:
                            t = float(time) / per_second
                        except (TypeError, ValueError):
                            t = None
                        extra = extra or {}
                        out.append((r.nth, i, r.rel, r.stem, topic, schema, t, extra.get("annotations") or [], extra.get("calibration") or [], None))
                except Exception as e:  # noqa: BLE001  any parser failure is reported for its file
                    error = f"parse error: {r.rel}: {e}"
                if error:
                    out.append((r.nth, len(out), r.rel, r.stem, None, None, None, [], [], error))
                yield pd.DataFrame(out, columns=["nth", "i", "rel", "stem", "topic", "schema", "time", "annotations", "calibration", "error"])

    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "nth bigint, rel string, stem string, path string")
    return rows.repartitionById(max(1, min(len(files), 1000)), F.pmod("nth", F.lit(max(1, min(len(files), 1000)))).cast("int")).mapInPandas(run, _MESSAGE)


def records(found: DataFrame, sequences: DataFrame) -> dict[str, DataFrame]:
    """Manifest tables of bounded messages; ``sequences`` has a row a file."""
    kind = X.topic_kind(F.col("topic"), F.coalesce("schema", F.lit("")))
    ident = F.concat_ws(":", "stem", "topic", F.col("i").cast("string"))
    ord_ = F.col("nth") * (1 << 32) + F.col("i")
    rows = found.select("*", ident.alias("frame_id"), kind.alias("kind"), ord_.alias("ord"))
    frames = rows.select("frame_id", F.col("stem").alias("sequence_id"), F.col("time").alias("timestamp"), F.col("topic").alias("sensor_id"), F.col("rel").alias("file_path"), F.to_json(F.struct("kind", "schema")).alias("metadata"), "ord")
    sensors = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("frame_count"), F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("ord"))
    sensors = sensors.select(F.col("topic").alias("sensor_id"), F.col("kind").alias("sensor_type"), F.col("topic").alias("name"), F.col("kind").alias("modality"), "frame_count", "ord")
    seen = rows.groupBy("stem").agg(F.count(F.lit(1)).alias("frame_count"), F.min("time").alias("start_time"), F.max("time").alias("end_time"))
    sequences = sequences.join(seen, sequences["sequence_id"] == seen["stem"], "left").drop("stem")
    notes = rows.select("frame_id", "stem", "ord", F.explode("annotations").alias("a"))
    annotations = notes.select(F.concat_ws(":", "frame_id", "a.id").alias("annotation_id"), "frame_id", F.col("stem").alias("sequence_id"), F.col("a.category").alias("category"), F.col("a.type").alias("annotation_type"), F.col("a.values").alias("values"), "ord")
    rigs = rows.select("ord", F.explode("calibration").alias("c")).groupBy("c.sensor_id").agg(F.min_by("c", "ord").alias("c"), F.min("ord").alias("ord"))
    return {"frames": frames, "sensors": sensors, "sequences": sequences, "annotations": annotations, "calibration": rigs.select("c.*", "ord")}
