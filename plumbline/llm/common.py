"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship_package

#: ASCII white space, as the operators define it (\x20 and \x09-\x0D).
ASCII_WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, whatever store it is in."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, this application's own part of it.

    ``spark.checkpoint.dir`` names the folder.  Only where that is unset and the
    master is local, as in tests, a temporary folder of this machine serves; on
    a cluster that would scatter tables over executors, so it is refused.  The
    part is deleted when the driver's JVM ends.
    """
    ship_package(spark)
    made = spark.conf.get("plumbline.shared.dir", None)
    if made:
        return made
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    made = f"{found.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(made)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    spark.conf.set("plumbline.shared.dir", made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; the table and its path.

    It cuts the lineage, and later jobs read the same rows in the same files
    even if an executor that made them is lost.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """:func:`written_at` without the path; the table stays as long as the application."""
    return written_at(df, label)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder in whatever store holds it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Held:
    """A caller's rows under column names of our own, so no name of theirs can clash with a helper column.

    ``df`` has the columns under numbers, ``[name]`` gives one of them, and
    :meth:`back` restores the names.  A result column that bears the name of a
    caller's column takes its place there, as with ``withColumn``.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.inner = [f"_{i}_" for i in range(len(self.names))]
        self.df = docs.toDF(*self.inner)

    def __getitem__(self, name: str) -> str:
        return self.inner[self.names.index(name)]

    def back(self, df: DataFrame, *results: str) -> DataFrame:
        taken = {r.lower() for r in results}
        own = [F.col(i).alias(n) for i, n in zip(self.inner, self.names, strict=True) if n.lower() not in taken]
        return df.select(*own, *results)


#: Bits of the filter over ids; it takes at most 8 MB however many ids there are.
FILTER_BITS = 1 << 26


def _flagged(df: DataFrame, id_col: str, ids: DataFrame, id_in: str) -> DataFrame:
    """``df`` with ``__may``: false only for rows whose id is surely not among ``ids``; a bitmap of id hashes is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS)) + 1
    bits = ids.where(F.col(id_in).isNotNull()).select(place(id_in).alias("h"))
    bits = bits.groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    marked = df.withColumn("__h", place(id_col)).join(F.broadcast(bits), F.bitmap_bucket_number("__h") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__h").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(7))) != 0, F.lit(False))
    return marked.withColumn("__may", may).drop("__h", "__bucket", "__bits")


def without_ids(df: DataFrame, id_col: str, ids: DataFrame, id_in: str = "doc") -> DataFrame:
    """Rows of ``df`` whose id isn't among ``ids``; only rows that may be among them are shuffled."""
    flagged = _flagged(df, id_col, ids, id_in)
    doubtful = flagged.where("__may").drop("__may")
    gone = ids.select(F.col(id_in).alias("__gone"))
    return flagged.where("NOT __may").drop("__may").unionByName(doubtful.join(gone, doubtful[id_col] == gone["__gone"], "left_anti"))


def only_ids(df: DataFrame, id_col: str, ids: DataFrame, id_in: str = "doc") -> DataFrame:
    """Rows of ``df`` whose id is among ``ids``; only rows that may be among them are shuffled."""
    some = _flagged(df, id_col, ids, id_in).where("__may").drop("__may")
    wanted = ids.select(F.col(id_in).alias("__wanted"))
    return some.join(wanted, some[id_col] == wanted["__wanted"], "left_semi")


#: Schemes that Spark and Arrow spell differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI, for use on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        path = uri[len("file:"):]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def commit_file(store, temp: str, final: str) -> None:
    """Give a whole file its final name; an equal one that another attempt left there stays.

    Final names follow from contents, so a file of that name and size is the
    same file, and stores that refuse to rename onto a name need no care.
    """
    from pyarrow import fs

    size = store.get_file_info(temp).size
    there = store.get_file_info(final)
    if there.type == fs.FileType.File and there.size == size:
        store.delete_file(temp)
        return
    if there.type == fs.FileType.File:
        store.delete_file(final)  # a torn file of a store that doesn't rename in one step
    try:
        store.move(temp, final)
    except OSError:
        if store.get_file_info(final).size != size:
            raise
        store.delete_file(temp)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that executors hold outside the heap for a Python worker, for what runs from now on; a smaller bound stays.

    Spark's own bound of 64 MB takes a whole file split of texts at once, on
    both sides and in both directions.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_worker(store_too: bool = True) -> None:
    """Give back what a Python worker still holds of earlier tasks: tables of the anchors, and the token store's piece cache, which serves that operator alone."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    simhash, store = (sys.modules.get(f"plumbline.llm.{name}") for name in ("simhash", "tokenstore"))
    if simhash is not None:
        simhash._tables.cache_clear()
    if store_too and store is not None and store.encoder.cache_info().currsize:
        store.encoder.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it trims by itself or not at all
