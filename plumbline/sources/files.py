"""File index of a dataset root, on local disks or any Hadoop store."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

INDEX = "rel_path string, name string, ext string, size bigint, is_dir boolean"


@dataclass(frozen=True)
class Entry:
    rel: str
    size: int
    is_dir: bool = False

    @property
    def name(self) -> str:
        return PurePosixPath(self.rel).name

    @property
    def stem(self) -> str:
        return PurePosixPath(self.rel).stem

    @property
    def ext(self) -> str:
        return PurePosixPath(self.rel).suffix.lower()

    @property
    def parts(self) -> tuple[str, ...]:
        return PurePosixPath(self.rel).parts


def is_remote(root: str) -> bool:
    return "://" in root


class Store:
    """Listing and small reads below a root; ``root`` may be one file."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        self.root = str(root).rstrip("/") or "/"
        self.spark = spark
        self._entries: list[Entry] | None = None

    @property
    def single_file(self) -> bool:
        return not is_remote(self.root) and os.path.isfile(self.root)

    @property
    def base(self) -> str:
        return os.path.dirname(self.root) if self.single_file else self.root

    def exists(self) -> bool:
        return bool(self.entries) if is_remote(self.root) else os.path.exists(self.root)

    @property
    def entries(self) -> list[Entry]:
        """Files and folders, sorted by path components."""
        if self._entries is None:
            found = self._remote() if is_remote(self.root) else self._local()
            self._entries = sorted(found, key=lambda e: e.parts)
        return self._entries

    def _local(self) -> list[Entry]:
        if os.path.isfile(self.root):
            return [Entry(os.path.basename(self.root), os.path.getsize(self.root))]
        out = []
        for folder, dirs, names in os.walk(self.root):
            rel = os.path.relpath(folder, self.root).replace(os.sep, "/")
            at = "" if rel == "." else rel + "/"
            out += [Entry(at + d, 0, True) for d in dirs]
            out += [Entry(at + n, os.path.getsize(os.path.join(folder, n))) for n in names if os.path.isfile(os.path.join(folder, n))]
        return out

    def _remote(self) -> list[Entry]:
        if self.root.startswith("hf://"):
            return []  # the name of a hub dataset, which its package reads; Spark has no such store
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        start, out, todo = len(top.toUri().getPath().rstrip("/")) + 1, [], [top]
        while todo:
            for s in fs.listStatus(todo.pop()):
                rel = s.getPath().toUri().getPath()[start:]
                out.append(Entry(rel, s.getLen(), s.isDirectory()))
                if s.isDirectory():
                    todo.append(s.getPath())
        return out

    @property
    def files(self) -> list[Entry]:
        return [e for e in self.entries if not e.is_dir]

    def match(self, pattern: str) -> list[Entry]:
        """Files whose path matches a glob, component by component."""
        n = len(PurePosixPath(pattern).parts)
        return [e for e in self.files if len(e.parts) == n and PurePosixPath(e.rel).match(pattern)]

    def has(self, rel: str) -> bool:
        return any(e.rel == rel for e in self.entries)

    def path(self, rel: str) -> str:
        return f"{self.base}/{rel}"

    def read_bytes(self, rel: str, n: int = -1) -> bytes:
        if not is_remote(self.root):
            with open(self.path(rel), "rb") as f:
                return f.read(n)
        row = self.spark.read.format("binaryFile").load(self.path(rel)).select("content").first()
        return bytes(row.content)[: n if n >= 0 else None]

    def read_text(self, rel: str) -> str:
        return self.read_bytes(rel).decode("utf-8-sig", "replace")

    def read_json(self, rel: str):
        return json.loads(self.read_text(rel))

    def json_object(self, rel: str) -> dict:
        """The object in a file, empty if there is no file or no object in it."""
        if not self.has(rel):
            return {}
        try:
            found = self.read_json(rel)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def json_list(self, rel: str) -> list[dict]:
        if not self.has(rel):
            return []
        try:
            found = self.read_json(rel)
        except ValueError:
            return []
        return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []

    def json_lines(self, rel: str) -> list[dict]:
        out = []
        for line in self.read_text(rel).splitlines() if self.has(rel) else []:
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if isinstance(x, dict):
                out.append(x)
        return out

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.rel, e.name, e.ext, e.size, e.is_dir) for e in self.entries], INDEX)

    def digest(self) -> str:
        """SHA-256 over paths and sizes in component order; no payload is read."""
        import hashlib

        h = hashlib.sha256()
        for e in self.files:
            h.update(f"{e.rel}\0{e.size}\0".encode())
        return f"sha256:{h.hexdigest()}"
