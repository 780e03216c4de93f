"""A native dataset folder as long DataFrames.

``sensors/*.csv``, ``labels/*.csv`` and ``trajectories/*.csv`` become one
DataFrame per modality with ``stream``, ``file`` and the spreadsheet ``row``
(header is 1) next to the raw text columns.  Files are read together by equal
header, so columns never shift, and a header table remembers which file has
which columns: a rule applies only to files that have its columns.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import LintConfig
from plumbline.functions import exprs as X
from plumbline.sources.files import Entry, Store

MODALITIES = ("sensors", "labels", "trajectories")


@dataclass
class Bundle:
    spark: SparkSession
    store: Store
    config: LintConfig
    metadata: dict | None = None
    calibration: dict | None = None
    headers: dict[str, dict[str, list[str]]] = field(default_factory=dict)  # modality -> file -> columns
    all_files: dict[str, list[str]] = field(default_factory=dict)  # also those that couldn't be read
    frames: dict[str, DataFrame | None] = field(default_factory=dict)
    load_findings: list[dict] = field(default_factory=list)
    cached: list[DataFrame] = field(default_factory=list)

    @property
    def declared_sensors(self) -> list[str]:
        s = (self.metadata or {}).get("sensors")
        return [x for x in s if isinstance(x, str)] if isinstance(s, list) else []

    @cached_property
    def index(self) -> DataFrame:
        return self.store.index(self.spark)

    def files_with(self, modality: str, *columns: str) -> list[str]:
        return [f for f, have in self.headers.get(modality, {}).items() if set(columns) <= set(have)]

    def rows(self, modality: str, *columns: str) -> DataFrame | None:
        """Rows of the modality's files that have all the columns, ``ts`` being the numeric timestamp."""
        df, files = self.frames.get(modality), self.files_with(modality, *columns)
        if df is None or not files:
            return None
        return df if len(files) == len(self.headers[modality]) else df.where(F.col("file").isin(*files))

    def release(self) -> None:
        """Give back what reading the files has cached."""
        for df in self.cached:
            df.unpersist()
        self.cached = []


def _header(store: Store, e: Entry) -> list[str] | None:
    if e.size == 0:
        return None
    text = store.read_bytes(e.rel, 1 << 16).decode("utf-8-sig", "replace")
    row = next(csv.reader(io.StringIO(text)), None)
    return [c.strip() for c in row] if row else None


def _read(spark: SparkSession, store: Store, modality: str, entries: list[Entry], header: list[str]) -> DataFrame:
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField("__bad", T.StringType())])
    paths = [store.path(e.rel) for e in entries]
    df = spark.read.schema(schema).csv(paths, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", enforceSchema=True)
    # row numbers straight on the scan: block order, then position
    rel = F.concat(F.lit(f"{modality}/"), F.col("_metadata.file_name"))
    df = df.select("*", rel.alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    row = F.row_number().over(Window.partitionBy("file").orderBy("__block", "__at")) + 1
    return df.withColumn("row", row.cast("int")).withColumn("stream", X.stem(F.col("file"))).drop("__block", "__at")


def load_bundle(spark: SparkSession, root: str, config: LintConfig) -> Bundle:
    store = Store(root, spark)
    b = Bundle(spark, store, config)
    for name in ("metadata", "calibration"):
        rel = f"{name}.json"
        if not store.has(rel):
            continue
        try:
            doc = store.read_json(rel)
            if not isinstance(doc, dict):
                raise ValueError("not an object")
            setattr(b, name, doc)
        except ValueError as e:
            b.load_findings.append({"check": "load_json", "severity": "error", "message": f"{rel} is not a JSON object: {e}", "file": rel})
    for modality in MODALITIES:
        _load_modality(b, modality)
    return b


def _load_modality(b: Bundle, modality: str) -> None:
    groups: dict[tuple[str, ...], list[Entry]] = {}
    b.headers[modality], entries = {}, b.store.match(f"{modality}/*.csv")
    b.all_files[modality] = [e.rel for e in entries]
    for e in entries:
        if header := _header(b.store, e):
            if len(set(header)) < len(header):
                b.load_findings.append({"check": "load_csv", "severity": "error", "message": f"{e.rel} repeats a column name", "file": e.rel})
                continue
            groups.setdefault(tuple(header), []).append(e)
    frames = []
    for header, group in groups.items():
        df = _read(b.spark, b.store, modality, group, list(header)).cache()
        b.cached.append(df)
        # a row with more fields than the header can't be placed: its file is out
        fields = F.size(F.split("__bad", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
        bad = {r.file for r in df.where(F.col("__bad").isNotNull() & (fields > len(header))).select("file").distinct().collect()}
        b.load_findings += [{"check": "load_csv", "severity": "error", "message": f"{f} has rows with more fields than its header", "file": f} for f in sorted(bad)]
        good = [e for e in group if e.rel not in bad]
        if not good:
            continue
        df = df.where(~F.col("file").isin(*bad)).drop("__bad") if bad else df.drop("__bad")
        columns = list(header)
        if "path" not in columns and "filename" in columns:
            cameras = F.lower("stream").contains("camera")
            df = df.withColumn("path", F.when(cameras, F.col("filename")))
        for e in good:
            renamed = "path" not in columns and "filename" in columns and "camera" in e.stem.lower()
            b.headers[modality][e.rel] = [("path" if c == "filename" and renamed else c) for c in columns]
        frames.append(df.withColumn("ts", X.num("timestamp") if "timestamp" in columns else F.lit(None).cast("double")))
    b.headers[modality] = dict(sorted(b.headers[modality].items()))
    b.frames[modality] = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames) if frames else None


def json_text(x) -> str:
    return json.dumps(x, sort_keys=True)
