"""Adapters of layouts made of JSON tables: COCO and nuScenes, read and joined by Spark."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import kernels as K
from plumbline.session import ship_package
from plumbline.sources.adapters.base import Adapter, Found
from plumbline.sources.files import Store


def _column(df: DataFrame, *path: str, kind: str = "string"):
    """A column that may be absent."""
    name = path[0]
    return (F.col(name) if name in df.columns else F.lit(None)).try_cast(kind)


class CocoAdapter(Adapter):
    name = "coco"
    checked = ("image files", "image and category links", "box sizes", "duplicate ids")
    SCHEMA = "images array<struct<id:string,file_name:string,width:int,height:int>>, annotations array<struct<id:string,image_id:string,category_id:string,bbox:array<double>,iscrowd:int,area:double>>, categories array<struct<id:string,name:string>>"

    def _files(self, store) -> list[str]:
        found = [e.rel for e in store.files if e.ext == ".json" and (len(e.parts) == 1 or e.parts[0] == "annotations" and e.name.startswith("instances_"))]
        return [f for f in found if all(k in store.read_bytes(f, 1 << 24) for k in (b'"images"', b'"annotations"', b'"categories"'))]

    def can_load(self, store):
        return not store.single_file and bool(self._files(store))

    def _docs(self, spark, store) -> DataFrame:
        paths = [store.path(f) for f in self._files(store)]
        docs = spark.read.schema(self.SCHEMA).json(paths, multiLine=True)
        name = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "^instances_", "")
        return docs.select("*", F.regexp_extract(name, "^(train|val|test)", 1).alias("split"), name.alias("set"))

    def find(self, spark, store, options):
        docs = self._docs(spark, store)
        images = docs.select("split", "set", F.posexplode("images").alias("ord", "i")).select("split", "set", "ord", "i.*")
        index = store.index(spark).where("NOT is_dir")
        tries = F.array(F.col("file_name"), F.concat(F.lit("images/"), "file_name"), F.concat_ws("/", "set", "file_name"), F.concat(F.lit("images/"), F.concat_ws("/", "set", "file_name")))
        placed = images.select("*", F.posexplode(tries).alias("nth", "try")).join(index.select(F.col("rel_path").alias("try"), F.lit(True).alias("there")), "try")
        first = placed.groupBy("set", "id").agg(F.min_by("try", "nth").alias("found"))
        images = images.join(first, ["set", "id"], "left")
        frames = images.select(F.col("id").alias("frame_id"), F.when(F.col("split") != "", F.col("split")).otherwise(F.col("set")).alias("sequence_id"), F.lit("camera").alias("sensor_id"), F.coalesce("found", F.concat(F.lit("images/"), "file_name")).alias("file_path"), "width", "height", "ord")
        cats = docs.select("set", F.posexplode("categories").alias("ord", "c")).select(F.col("c.id").alias("cid"), F.col("c.name").alias("cname"), F.struct("set", "ord").alias("cord"))
        notes = docs.select("set", "split", F.posexplode("annotations").alias("ord", "a")).select("set", "split", "ord", "a.*")
        notes = K.lookup(notes, "category_id", cats, "cid", "cord", ["cname"])
        annotations = notes.select(F.coalesce("id", F.concat_ws(":", "set", F.col("ord").cast("string"))).alias("annotation_id"), F.col("image_id").alias("frame_id"), F.when(F.col("split") != "", F.col("split")).otherwise(F.col("set")).alias("sequence_id"), F.coalesce("cname", "category_id").alias("category"), F.lit("bbox").alias("annotation_type"), F.to_json(F.struct("bbox", "area")).alias("values"), F.to_json(F.struct("category_id", "iscrowd")).alias("metadata"), "ord")
        seqs = frames.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("frame_count")).select("sequence_id", F.col("sequence_id").alias("name"), "frame_count", F.lit(0).alias("ord"))
        sensor = frames.agg(F.count(F.lit(1)).alias("frame_count")).where("frame_count > 0").select(F.lit("camera").alias("sensor_id"), F.lit("camera").alias("sensor_type"), F.lit("camera").alias("name"), "frame_count", F.lit(0).alias("ord"))
        splits = frames.where(F.col("sequence_id").isin("train", "val", "test")).select(F.col("sequence_id").alias("split"), "frame_id", "ord")
        rows = {"frames": frames, "annotations": annotations, "sequences": seqs, "sensors": sensor, "splits": splits}
        return Found(store.root.rsplit("/", 1)[-1], rows=rows, metadata={"files": self._files(store)})

    def problems(self, spark, store, m, options):
        docs = self._docs(spark, store).cache()
        errors, warnings = [], []
        index = store.index(spark)
        errors += [f"image file is missing: {r.file_path}" for r in K.broken_links(m.frames, "file_path", index, "rel_path", guarded=False).orderBy("ord").collect()]
        errors += [f"annotation {r.annotation_id} names an unknown image: {r.frame_id}" for r in K.broken_links(m.annotations, "frame_id", m.frames, "frame_id", guarded=False).orderBy("ord").collect()]
        cats = docs.select(F.explode("categories").alias("c")).select("c.*")
        kept = m.annotations.select("annotation_id", F.get_json_object("metadata", "$.category_id").alias("category_id"), "ord")
        errors += [f"annotation {r.annotation_id} names an unknown category: {r.category_id}" for r in K.broken_links(kept, "category_id", cats, "id", guarded=False).orderBy("ord").collect()]
        box = F.from_json(F.get_json_object("values", "$.bbox"), "array<double>")
        flat = m.annotations.select("annotation_id", "ord", box.alias("b")).where((F.size("b") >= 4) & ((F.try_element_at("b", F.lit(3)) <= 0) | (F.try_element_at("b", F.lit(4)) <= 0)))
        errors += [f"box of annotation {r.annotation_id} has no area" for r in flat.orderBy("ord").collect()]
        if cats.isEmpty():
            errors.append("no categories")
        for what, df, key in (("image", m.frames, "frame_id"), ("annotation", m.annotations, "annotation_id")):
            if df.isEmpty():
                warnings.append(f"no {what}s")
            warnings += [f"{what} id occurs {r.n} times: {r.key}" for r in K.repeated_keys(df, key).orderBy("key").collect()]
        docs.unpersist()
        return errors, warnings


TABLES = ("sample", "sample_data", "scene", "calibrated_sensor", "sensor", "ego_pose")


class NuScenesAdapter(Adapter):
    name = "nuscenes"
    checked = ("table links", "payload files", "scene times", "calibration")

    def _folder(self, store) -> str | None:
        dirs = sorted({"/".join(e.parts[:-1]) for e in store.files if e.name.removesuffix(".json") in TABLES and e.ext == ".json"}, key=lambda d: (not d.rsplit("/", 1)[-1].startswith("v1.0"), d))
        return dirs[0] if dirs and len(dirs[0].split("/")) <= 1 else None

    def can_load(self, store):
        at = self._folder(store)
        return at is not None and any(store.has(f"{at}/{t}.json" if at else f"{t}.json") for t in ("sample", "sample_data"))

    def table(self, spark, store, name: str) -> DataFrame:
        at = self._folder(store)
        rel = f"{at}/{name}.json" if at else f"{name}.json"
        if not store.has(rel) or not store.json_list(rel):
            return spark.createDataFrame([], "token string, ord bigint")
        df = spark.read.json(store.path(rel), multiLine=True, primitivesAsString=True)
        for c in ("token", "sample_token", "calibrated_sensor_token", "ego_pose_token", "sensor_token", "scene_token", "filename", "channel", "modality", "timestamp", "category_name", "name"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df.withColumn("ord", F.monotonically_increasing_id())

    def find(self, spark, store, options):
        t = {n: self.table(spark, store, n) for n in (*TABLES, "sample_annotation")}
        at = self._folder(store)
        micro = lambda c: c.try_cast("double") / 1e6
        if "filename" not in t["sample_data"].columns:
            frames = spark.createDataFrame([], "frame_id string, sequence_id string, sensor_id string, timestamp double, file_path string, ord bigint, sample_token string, ego_pose_token string, calibrated_sensor_token string, ctoken string")
            sensors = frames.select("sensor_id")
        else:
            d = t["sample_data"]
            cal = t["calibrated_sensor"] if "sensor_token" in t["calibrated_sensor"].columns else t["calibrated_sensor"].withColumn("sensor_token", F.lit(None).cast("string"))
            d = K.lookup(d, "calibrated_sensor_token", cal.withColumnRenamed("token", "ctoken").select("ctoken", F.col("sensor_token").alias("stoken"), F.col("ord").alias("o")), "ctoken", "o", ["stoken"])
            sensor = t["sensor"] if "channel" in t["sensor"].columns else t["sensor"].withColumns({"channel": F.lit(None).cast("string"), "modality": F.lit(None).cast("string")})
            d = K.lookup(d, "stoken", sensor.select(F.col("token").alias("k"), F.col("channel").alias("schannel"), F.col("modality").alias("smodality"), F.col("ord").alias("o")), "k", "o", ["schannel", "smodality"])
            sample = t["sample"] if "scene_token" in t["sample"].columns else t["sample"].withColumns({"scene_token": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("string")})
            d = K.lookup(d, "sample_token", sample.select(F.col("token").alias("k"), F.col("scene_token").alias("scene"), F.col("timestamp").alias("stime"), F.col("ord").alias("o")), "k", "o", ["scene", "stime"])
            blank = lambda c: F.nullif(c, F.lit(""))
            name = F.coalesce(blank(F.col("schannel")), blank(F.col("channel")), blank(F.col("stoken")), F.lit("unknown"))
            kind = F.coalesce(blank(F.col("smodality")), F.when(name.startswith("CAM"), "camera").when(name.startswith("LIDAR"), "lidar").when(name.startswith("RADAR"), "radar").otherwise("other"))
            # payloads lie at the root or beside the tables
            beside = F.concat(F.lit(f"{at}/" if at else ""), "filename")
            index = store.index(spark).select(F.col("rel_path").alias("__b"), F.lit(True).alias("__there"))
            d = d.withColumn("__b", beside).join(index, "__b", "left")
            frames = d.select(F.col("token").alias("frame_id"), F.col("scene").alias("sequence_id"), micro(F.coalesce("timestamp", "stime")).alias("timestamp"), name.alias("sensor_id"), F.when(F.col("__there"), F.col("__b")).otherwise(F.col("filename")).alias("file_path"), _column(d, "width", kind="int").alias("width"), _column(d, "height", kind="int").alias("height"), F.to_json(F.struct(kind.alias("kind"), "sample_token", "ego_pose_token", "calibrated_sensor_token")).alias("metadata"), "ord")
            sensors = frames
        kinds = F.get_json_object("metadata", "$.kind") if "metadata" in frames.columns else F.lit("other")
        sensors = frames.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("frame_count"), F.first(kinds).alias("sensor_type")).select("sensor_id", "sensor_type", F.col("sensor_id").alias("name"), F.col("sensor_type").alias("modality"), "frame_count", F.lit(0).alias("ord"))
        per = frames.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("frame_count"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
        scenes = t["scene"] if "name" in t["scene"].columns else t["scene"].withColumn("name", F.lit(None).cast("string"))
        sequences = scenes.select(F.col("token").alias("sequence_id"), "name", "ord").join(per, "sequence_id", "left")
        notes = t["sample_annotation"]
        if "sample_token" in notes.columns:
            notes = K.lookup(notes, "sample_token", frames.select(F.get_json_object("metadata", "$.sample_token").alias("k"), F.col("frame_id").alias("fid"), F.col("sequence_id").alias("sid"), (-F.col("ord")).alias("o")), "k", "o", ["fid", "sid"]) if "metadata" in frames.columns else notes.withColumns({"fid": F.lit(None), "sid": F.lit(None)})
            parts = [c for c in ("translation", "size", "rotation") if c in notes.columns]
            notes = notes.select(F.col("token").alias("annotation_id"), F.col("fid").alias("frame_id"), F.col("sid").alias("sequence_id"), F.col("category_name").alias("category"), F.lit("bbox_3d").alias("annotation_type"), F.to_json(F.struct(*parts)).alias("values") if parts else F.lit("{}").alias("values"), F.to_json(F.struct("sample_token")).alias("metadata"), "ord")
        else:
            notes = spark.createDataFrame([], "annotation_id string")
        cal = t["calibrated_sensor"]
        if "sensor_token" in cal.columns and "channel" in t["sensor"].columns:
            cal = K.lookup(cal, "sensor_token", t["sensor"].select(F.col("token").alias("k"), F.col("channel").alias("ch"), F.col("ord").alias("o")), "k", "o", ["ch"])
            m3 = F.col("camera_intrinsic").try_cast("array<array<double>>") if "camera_intrinsic" in cal.columns and "array<array" in dict(cal.dtypes)["camera_intrinsic"] else F.lit(None)
            intrinsic = F.when(F.size(m3) > 0, m3) if "camera_intrinsic" in cal.columns else m3
            cal = cal.select(F.coalesce("ch", "sensor_token").alias("sensor_id"), intrinsic.alias("intrinsic"), F.to_json(F.struct("token")).alias("metadata"), "ord")
        else:
            cal = spark.createDataFrame([], "sensor_id string")
        limits = ["payload headers of a bounded sample only"] if options.deep else ["payloads are not opened"]
        rows = {"frames": frames, "sensors": sensors, "sequences": sequences, "annotations": notes, "calibration": cal}
        return Found(store.root.rsplit("/", 1)[-1], at or None, rows, {"folder": at}, limits)

    def problems(self, spark, store, m, options):
        errors, warnings = [], []
        t = {n: self.table(spark, store, n) for n in (*TABLES, "sample_annotation")}
        at = self._folder(store)
        if not store.has(f"{at}/ego_pose.json" if at else "ego_pose.json"):
            warnings.append("ego_pose.json is missing")
        for table, key, target in (("sample_data", "sample_token", "sample"), ("sample_data", "ego_pose_token", "ego_pose"), ("sample_data", "calibrated_sensor_token", "calibrated_sensor"), ("calibrated_sensor", "sensor_token", "sensor"), ("sample_annotation", "sample_token", "sample")):
            if key in t[table].columns:
                for r in K.broken_links(t[table], key, t[target], "token").orderBy("ord").collect():
                    errors.append(f"{table} {r.token} names an unknown {target}: {r[key]}")
        w = Window.partitionBy("sequence_id").orderBy("ord")
        back = m.frames.where("timestamp IS NOT NULL AND sequence_id IS NOT NULL").withColumn("d", F.col("timestamp") - F.lag("timestamp").over(w)).where("d < 0")
        errors += [f"times of scene {r.sequence_id} decrease" for r in back.select("sequence_id").distinct().orderBy("sequence_id").collect()]
        if options.deep:
            for r in payload_summary(m.frames, store, options.max_rows).where("problem IS NOT NULL").orderBy("ord").collect():
                errors.append(f"payload of frame {r.frame_id}: {r.problem}")
        return errors, warnings


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF or JPEG."""
    if raw.startswith(b"\x89PNG\r\n\x1a\n") and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if not raw.startswith(b"\xff\xd8"):
        return None
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
            return w, h
        at += 2 if marker == 0xFF or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def cloud_points(raw: bytes) -> int | None:
    """Number of points that a PCD head declares."""
    head = raw[:4096].decode("latin-1").split("\nDATA", 1)[0]
    if "VERSION" not in head:
        return None
    found = {x.split()[0]: x.split()[1:] for x in head.splitlines() if x.strip() and not x.startswith("#")}
    try:
        return int(found["POINTS"][0]) if "POINTS" in found else int(found["WIDTH"][0]) * int(found["HEIGHT"][0])
    except (KeyError, ValueError, IndexError):
        return None


def payload_problem(path: str, raw: bytes, size: int) -> tuple[str | None, int | None, int | None, int | None]:
    """(problem, width, height, points) of one payload."""
    low = path.lower()
    if size == 0:
        return "empty file", None, None, None
    if low.endswith((".png", ".gif", ".jpg", ".jpeg")):
        wh = image_size(raw)
        return (None, *map(int, wh), None) if wh else ("unreadable image head", None, None, None)
    if low.endswith(".pcd"):
        n = cloud_points(raw)
        return (None, None, None, n) if n is not None else ("unreadable PCD head", None, None, None)
    if low.endswith(".bin"):
        return (None, None, None, size // 20) if size % 20 == 0 else ("size is no multiple of 20 bytes", None, None, None)
    return None, None, None, None


def payload_summary(frames: DataFrame, store: Store, max_rows: int) -> DataFrame:
    """Heads of the first ``max_rows`` payloads, opened on the executors."""
    spark = frames.sparkSession
    ship_package(spark)
    sizes = store.index(spark).where("NOT is_dir").select(F.col("rel_path").alias("file_path"), "size")
    some = frames.orderBy("ord").limit(max_rows).select("frame_id", "file_path", "ord").join(sizes, "file_path")
    base = store.base

    def run(batches):
        import pandas as pd

        from plumbline.sources.files import is_remote

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if is_remote(base):
                    from pyarrow import fs as pafs

                    fs, at = pafs.FileSystem.from_uri(base)
                    raw = fs.open_input_file(f"{at}/{r.file_path}").read(1 << 18)
                else:
                    with open(f"{base}/{r.file_path}", "rb") as f:
                        raw = f.read(1 << 18)
                out.append((r.frame_id, r.file_path, r.ord, *payload_problem(r.file_path, raw, r.size)))
            made = pd.DataFrame(out, columns=["frame_id", "file_path", "ord", "problem", "width", "height", "points"])
            yield made.astype({c: "Int64" for c in ("width", "height", "points")})

    return some.mapInPandas(run, "frame_id string, file_path string, ord bigint, problem string, width bigint, height bigint, points bigint")
