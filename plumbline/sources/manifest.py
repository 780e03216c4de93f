"""Normalized manifests: five record tables, splits and a header."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX = "array<array<double>>"
#: Open dicts (metadata, values) are JSON texts; ``ord`` is the place in the manifest.
SCHEMAS = {
    "sequences": "sequence_id string, name string, split string, frame_count bigint, start_time double, end_time double, metadata string, ord bigint",
    "frames": "frame_id string, sequence_id string, timestamp double, sensor_id string, file_path string, width int, height int, checksum string, metadata string, ord bigint",
    "sensors": "sensor_id string, sensor_type string, name string, modality string, frequency_hz double, frame_count bigint, metadata string, ord bigint",
    "annotations": "annotation_id string, frame_id string, sequence_id string, category string, annotation_type string, values string, metadata string, ord bigint",
    "calibration": f"sensor_id string, target_sensor_id string, intrinsic {MATRIX}, extrinsic {MATRIX}, distortion array<double>, metadata string, ord bigint",
    "splits": "split string, frame_id string, ord bigint",
}
TABLES = tuple(SCHEMAS)


def fields(name: str) -> list[T.StructField]:
    return T._parse_datatype_string(SCHEMAS[name]).fields


def _plain(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, sort_keys=True)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.LongType | T.IntegerType):
        return int(value)
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in value]
    return value


def records(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """A record table from dicts; absent fields are null, ``ord`` is the order given."""
    cols = fields(name)
    return spark.createDataFrame([tuple(i if c.name == "ord" else _plain(r.get(c.name), c.dataType) for c in cols) for i, r in enumerate(rows)], SCHEMAS[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """A derived table with the columns and types of its schema."""
    return df.select(*[(F.col(c.name).cast(c.dataType) if c.name in df.columns else F.lit(None).cast(c.dataType)).alias(c.name) for c in fields(name)])


@dataclass
class Manifest:
    dataset_name: str
    adapter_name: str
    dataset_root: str
    tables: dict[str, DataFrame]
    version: str | None = None
    metadata: dict = field(default_factory=dict)
    limitations: list[str] = field(default_factory=list)
    provenance: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.__dict__["tables"][name]
        raise AttributeError(name)

    def iter_frames(self, sequence_id: str | None = None) -> DataFrame:
        return self.frames if sequence_id is None else self.frames.where(F.col("sequence_id") == sequence_id)

    def iter_annotations(self, sequence_id: str | None = None) -> DataFrame:
        return self.annotations if sequence_id is None else self.annotations.where(F.col("sequence_id") == sequence_id)

    def timestamps(self, sensor_id: str | None = None) -> DataFrame:
        df = self.frames.where("timestamp IS NOT NULL")
        return (df if sensor_id is None else df.where(F.col("sensor_id") == sensor_id)).select("timestamp")

    def counts(self) -> dict[str, int]:
        return {t: self.tables[t].count() for t in TABLES}

    def to_dict(self) -> dict:
        """The whole manifest on the driver, for exports of indexes; tables of data stay DataFrames."""
        def rows(t):
            out = [r.asDict(recursive=True) for r in self.tables[t].orderBy("ord").collect()]
            for r in out:
                r.pop("ord")
                for k in ("metadata", "values"):
                    if k in r:
                        r[k] = json.loads(r[k]) if r[k] else {}
            return out

        splits: dict[str, list[str]] = {}
        for r in rows("splits"):
            splits.setdefault(r["split"], []).append(r["frame_id"])
        head = {k: v for k, v in self.__dict__.items() if k != "tables"}
        return head | {t: rows(t) for t in TABLES if t != "splits"} | {"splits": splits}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True, default=str)

    def write(self, folder: str) -> None:
        """Record tables as Parquet below a folder."""
        for t in TABLES:
            self.tables[t].write.mode("overwrite").parquet(f"{folder}/{t}")


def make_manifest(spark: SparkSession, name: str, adapter: str, root: str, rows: dict[str, list[dict] | DataFrame], **head) -> Manifest:
    tables = {t: conformed(x, t) if isinstance(x := rows.get(t, []), DataFrame) else records(spark, t, x) for t in TABLES}
    return Manifest(name, adapter, root, tables, **head)
