"""Incremental, reversible line dedup.

State of a :class:`LineIndex`, all of it tables in the shared folder, laid out
by hash shards of the line keys (128 bits of hash of the stripped, lower-cased
line):

* the exact reference table: one row (key, doc) for each document that holds
  a line key.  The reference count of a key is the number of its rows, and its
  keeper the largest document;
* the active keys (reference count at or above the threshold) with keepers;
* for each shard a cuckoo filter over its active keys.

An insertion or deletion finds the shards of the documents' keys and writes
those anew, as a generation of its own; the other shards stay where they are,
unread.  In a touched shard, keys whose count crossed the threshold upwards go
into the stored filter, those that crossed it downwards are deleted from it;
only a filter that is full is built anew, larger.  An index is never changed
in place, so an earlier one stays good, and when a count falls below the
threshold the lines come back.  Shards are dealt anew, four times as many, when
they hold over four times ``keys_per_shard`` active keys.

To apply the index, the filters screen the lines of each document: only keys
that a filter lets pass go on to the exact table, which confirms them (a false
positive of a filter costs a row, never a line).  Filters of up to
``max_filter_bytes`` in all are broadcast and screen lines where the texts lie;
beyond that keys go to their shard's filter, a shard being dealt out over
salts of the documents so that a hot key doesn't meet in one task.

Counts are summed before each shuffle, a hot key is one row per document at
most and is split when the reference table is written; the join of candidates
with the active keys is an ordinary join, so skewed keys are split at run time.

Defined cases: null or empty text is one empty line.  A row whose doc_id is
null holds no references: it neither counts nor loses lines.  Repeated rows of
a doc_id count once and are treated alike.  Keys shorter than ``min_chars``
code points are never touched.  Ids are whole numbers.  Extra columns pass
through; a result column takes the place of a caller's of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Held, scratch, shuffle_partitions, table, text_bytes, written


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 hash bytes of the key of a line, None if the key is too short."""
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    n = len(key)
    if n < min_chars:
        return None
    if n < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; membership, insertion and deletion.

    Keys are pairs of 64-bit hash halves.  The second bucket is the first one
    xor a hash of the fingerprint, so either bucket follows from the other.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / cls.SLOTS / 0.85)))))

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets, for arrays of unsigned halves."""
        fp = ((lo >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        mask = np.uint64(self.n - 1)
        one = hi & mask
        return fp, one.astype(np.int64), self._other(one, fp).astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        spread = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return bucket ^ ((spread >> np.uint64(20)) & np.uint64(self.n - 1))

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(hi, lo)
        return (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)

    def insert(self, hi: int, lo: int) -> bool:
        """False if the filter is full; the caller then builds a larger one."""
        f, a, b = (x[0] for x in self.places(np.array([hi], np.uint64), np.array([lo], np.uint64)))
        f, a, b = int(f), int(a), int(b)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = f
                return True
        bucket = b
        for kick in range(self.KICKS):
            slot = (f + kick) % self.SLOTS
            f, self.table[bucket, slot] = int(self.table[bucket, slot]), f
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([f], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = f
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        f, a, b = (x[0] for x in self.places(np.array([hi], np.uint64), np.array([lo], np.uint64)))
        for bucket in (int(a), int(b)):
            held = np.flatnonzero(self.table[bucket] == f)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        n = len(hi)
        while True:
            made = cls.sized(n)
            if made._fill(hi, lo):
                return made
            n = int(n * 1.5) + 8

    def _fill(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Bulk insertion: first choices at once, the rest one by one."""
        fp, one, _ = self.places(hi, lo)
        order = np.argsort(one, kind="stable")
        b = one[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0)) if len(b) else np.zeros(0, int)
        fits = rank < self.SLOTS
        self.table[b[fits], rank[fits]] = fp[order][fits]
        return all(self.insert(int(hi[i]), int(lo[i])) for i in order[~fits])


def _halves(keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


_REFS = "hi bigint, lo bigint, doc bigint"


def _emit_keys(min_chars: int, screen):
    """Distinct keys of each document, as (hi, lo, doc); ``screen`` holds broadcast filters or None."""

    def run(batches):
        filters = None if screen is None else {s: CuckooFilter(n, np.frombuffer(b, np.uint16).reshape(n, CuckooFilter.SLOTS)) for s, n, b in screen.value[1]}
        shards = 1 if screen is None else screen.value[0]
        for batch in batches:
            keys: list[bytes] = []
            counts: list[int] = []
            ids = batch.column(0)
            for doc, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set() if doc is None else {k for line in text_bytes(text).split(b"\n") if (k := line_key(line, min_chars))}
                keys.extend(own)
                counts.append(len(own))
            hi, lo = _halves(keys)
            doc = np.repeat(np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64), counts)
            if filters is not None and len(hi):
                keep = np.zeros(len(hi), bool)
                shard = (hi >> np.uint64(40)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if (f := filters.get(int(shard[part[0]]))) is not None:
                        keep[part] = f.contains(hi[part], lo[part])
                hi, lo, doc = hi[keep], lo[keep], doc[keep]
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(doc)], names=["hi", "lo", "doc"])

    return run


def _screened(batches):
    """Rows (shard, salt, n_buckets, filter, hi, lo, doc) sorted, the filter of a shard and salt first: the keys that it lets pass."""
    now, held = None, None
    for batch in batches:
        shard, salt = (batch.column(i).to_numpy() for i in (0, 1))
        hi, lo = (batch.column(i).fill_null(0).to_numpy().astype(np.int64).view(np.uint64) for i in (4, 5))
        keep = np.zeros(batch.num_rows, bool)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
            if a == b:
                continue
            if now != (shard[a], salt[a]):
                now, held = (shard[a], salt[a]), None
            if batch.column(3)[a].is_valid:
                n = batch.column(2)[a].as_py()
                held = CuckooFilter(n, np.frombuffer(batch.column(3)[a].as_py(), np.uint16).reshape(n, CuckooFilter.SLOTS))
                a += 1
            if held is not None:
                keep[a:b] = held.contains(hi[a:b], lo[a:b])
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (4, 5, 6)], names=["hi", "lo", "doc"])


def _refilter(t: pa.Table) -> pa.Table:
    """Rows of a shard (shard, hi, lo, was, now, n_buckets, filter), its stored filter being a row without a key: its filter with the keys that changed."""
    stored = t.filter(pc.is_valid(t.column("filter")))
    keys = t.filter(pc.is_null(t.column("filter")))
    hi, lo = (keys.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
    was, now = (keys.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("was", "now"))
    made, built = None, False
    if stored.num_rows:
        n = stored.column("n_buckets")[0].as_py()
        made = CuckooFilter(n, np.frombuffer(stored.column("filter")[0].as_py(), np.uint16).reshape(n, CuckooFilter.SLOTS).copy())
        for a, b in zip(hi[was & ~now].tolist(), lo[was & ~now].tolist(), strict=True):
            made.delete(a, b)
        if not all(made.insert(a, b) for a, b in zip(hi[now & ~was].tolist(), lo[now & ~was].tolist(), strict=True)):
            made = None
    if made is None:
        made, built = CuckooFilter.of(hi[now], lo[now]), True
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "keys": pa.array([int(now.sum())], pa.int64()), "n_buckets": pa.array([made.n], pa.int64()), "filter": pa.array([made.table.tobytes()], pa.binary()), "built": pa.array([built])})


_SCHEMAS = {
    "refs": f"{_REFS}, shard bigint",
    "active": "hi bigint, lo bigint, refs bigint, keeper bigint, shard bigint",
    "filters": "keys bigint, n_buckets bigint, filter binary, built boolean, shard bigint",
}


class LineIndex:
    """Reference counts of line keys, with cuckoo filters over the active ones.

    ``parts`` says for each shard that holds anything in which folder it lies.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 20, min_docs: int = 3, keys_per_shard: int = 100_000, max_filter_bytes: int = 32 << 20, shards: int = 16, parts: dict[int, str] | None = None):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.keys_per_shard, self.max_filter_bytes = keys_per_shard, max_filter_bytes
        self.shards, self.parts = shards, parts or {}

    # -- stored tables --

    def _table(self, kind: str, among=None) -> DataFrame:
        """Rows of a stored table, of some shards only if ``among`` is given; other shards' files are not read."""
        folders: dict[str, list[int]] = {}
        for shard, folder in self.parts.items():
            if among is None or shard in among:
                folders.setdefault(folder, []).append(shard)
        schema = T._parse_datatype_string(_SCHEMAS[kind])
        out = self.spark.createDataFrame([], schema)
        for folder, shards in folders.items():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{folder}/{kind}").where(F.col("shard").isin(shards)))
        return out

    @property
    def refs(self) -> DataFrame:
        return self._table("refs").drop("shard")

    @property
    def active(self) -> DataFrame:
        """(hi, lo, refs, keeper, shard) of the keys at or above the threshold."""
        return self._table("active")

    @property
    def filters(self) -> DataFrame:
        """(keys, n_buckets, filter, built, shard); ``built`` if the last change built the filter anew."""
        return self._table("filters")

    # -- changes --

    def _keys(self, docs: DataFrame, id_col: str, text_col: str, screen=None) -> DataFrame:
        slim = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
        return slim.mapInArrow(_emit_keys(self.min_chars, screen), _REFS)

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.shiftrightunsigned("hi", 40) % self.shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with the references of ``docs`` added; documents already in it keep theirs once."""
        return self._changed(self._keys(docs, id_col, text_col), True)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> LineIndex:
        """The index without the references of the given documents.

        With their texts only the shards of their lines are read; by ids alone
        the whole reference table is searched for them.
        """
        if text_col is not None:
            return self._changed(self._keys(docs, id_col, text_col), False)
        gone = docs.select(F.col(id_col).cast("bigint").alias("doc")).distinct()
        return self._changed(self.refs.join(gone, "doc", "left_semi").select("hi", "lo", "doc"), False)

    def _changed(self, change: DataFrame, add: bool) -> LineIndex:
        # of an empty index the change is all there is: it is written as the new shards at once
        if self.parts:
            change = written(self._sharded(change).distinct(), "line-change")
            touched = {r.shard for r in change.select("shard").distinct().collect()}  # at most one row a shard
            before = self._table("refs", touched)
            keys = ["hi", "lo", "doc", "shard"]
            refs = before.unionByName(change.select(before.columns)).distinct() if add else before.join(change.select(keys), keys, "left_anti")
        else:
            touched, refs = None, self._sharded(change).distinct() if add else self._sharded(change).limit(0)
        folder = scratch(self.spark, "line-index")
        self._write(refs, folder, "refs")
        return self._recounted(folder, touched)._fitted()

    def _write(self, df: DataFrame, folder: str, kind: str) -> None:
        names = [f.name for f in T._parse_datatype_string(_SCHEMAS[kind])]
        # rows of a shard lie together, a large shard in several files
        df.select(names).hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(f"{folder}/{kind}")

    def _recounted(self, folder: str, touched: set[int] | None) -> LineIndex:
        """The index with the shards below ``folder`` (only the touched ones, if given) in place of its own."""
        read = lambda kind: self.spark.read.schema(T._parse_datatype_string(_SCHEMAS[kind])).parquet(f"{folder}/{kind}")
        counts = read("refs").groupBy("hi", "lo", "shard").agg(F.count(F.lit(1)).alias("refs"), F.max("doc").alias("keeper"))
        self._write(counts.where(F.col("refs") >= self.min_docs), folder, "active")
        now = read("active").select("hi", "lo", "shard", F.lit(True).alias("now"))
        old = set() if touched is None else touched & set(self.parts)
        was = self._table("active", old).select("hi", "lo", "shard", F.lit(True).alias("was"))
        keys = now.join(was, ["hi", "lo", "shard"], "full_outer") if old else now.withColumn("was", F.lit(False))
        keys = keys.select("shard", "hi", "lo", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"), F.lit(None).cast("bigint").alias("n_buckets"), F.lit(None).cast("binary").alias("filter"))
        none, no = F.lit(None).cast("bigint"), F.lit(False)
        if old:
            keys = keys.unionByName(self._table("filters", old).select("shard", none.alias("hi"), none.alias("lo"), no.alias("was"), no.alias("now"), "n_buckets", "filter"))
        self._write(keys.groupBy("shard").applyInArrow(_refilter, "shard bigint, keys bigint, n_buckets bigint, filter binary, built boolean"), folder, "filters")
        there = {r.shard for r in read("refs").select("shard").distinct().collect()}
        parts = {s: f for s, f in self.parts.items() if touched is not None and s not in touched}
        return self._with(self.shards, parts | {s: folder for s in there})

    def _fitted(self) -> LineIndex:
        """The index with four times the shards as long as they hold too many keys."""
        held, index = self.filters.agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0], self
        shards = self.shards
        while held > 4 * self.keys_per_shard * shards:
            shards *= 4
        if shards > self.shards:
            index, folder = self._with(shards, {}), scratch(self.spark, "line-index")
            index._write(index._sharded(self.refs), folder, "refs")
            index = index._recounted(folder, None)
        return index

    def _with(self, shards: int, parts: dict[int, str]) -> LineIndex:
        return LineIndex(self.spark, self.min_chars, self.min_docs, self.keys_per_shard, self.max_filter_bytes, shards, parts)

    # -- use --

    def drops(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
        """(doc, keys): the keys whose lines a document loses."""
        filters = self.filters.select("shard", "n_buckets", "filter")
        size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        if size <= self.max_filter_bytes:
            screen = self.spark.sparkContext.broadcast((self.shards, [tuple(r) for r in filters.collect()]))
            candidates = self._keys(docs, id_col, text_col, screen)
        else:
            keys = self._sharded(self._keys(docs, id_col, text_col)).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
            every = filters.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))
            rows = every.unionByName(keys, allowMissingColumns=True).select("shard", "salt", "n_buckets", "filter", "hi", "lo", "doc")
            dealt = rows.repartition(shuffle_partitions(self.spark), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("n_buckets").asc_nulls_last())
            candidates = dealt.mapInArrow(_screened, _REFS)
        hit = candidates.join(self.active.select("hi", "lo", "keeper"), ["hi", "lo"]).where(F.col("doc") != F.col("keeper"))
        return hit.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("__drop"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with ``__n_lines``, ``__n_dropped`` and ``__kept`` (the text that stays)."""
        return self._rebuilt(docs, id_col, text_col, False)

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As :meth:`apply`, with ``__kept`` as its SHA-256 in place of the text."""
        return self._rebuilt(docs, id_col, text_col, True)

    def _rebuilt(self, docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
        drop, held = self.drops(docs, id_col, text_col), Held(docs)
        joined = held.df.join(drop, F.col(held[id_col]).cast("bigint") == drop["doc"], "left").drop("doc")
        n = len(held.inner)
        schema = T.StructType([*held.df.schema.fields, *T._parse_datatype_string("__n_lines bigint, __n_dropped bigint, __kept string").fields])
        at, min_chars = held.inner.index(held[text_col]), self.min_chars

        def run(batches):
            for batch in batches:
                lines_out, dropped_out, kept_out = [], [], []
                drops = batch.column(n)
                flat = drops.flatten()
                hi, lo = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                raw = np.stack([hi, lo], 1).astype(">i8").tobytes()
                end = 0
                for text, size in zip(batch.column(at).to_pylist(), drops.value_lengths().fill_null(0).to_pylist(), strict=True):
                    start, end = end, end + size
                    lines = text_bytes(text).split(b"\n")
                    kept = lines
                    if size:
                        gone = {raw[16 * i : 16 * i + 16] for i in range(start, end)}
                        kept = [x for x in lines if line_key(x, min_chars) not in gone]
                    lines_out.append(len(lines))
                    dropped_out.append(len(lines) - len(kept))
                    body = b"\n".join(kept)
                    kept_out.append(hashlib.sha256(body).hexdigest() if digest else body.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lines_out, pa.int64()), pa.array(dropped_out, pa.int64()), pa.array(kept_out, pa.string())], names=schema.names)

        return held.back(joined.mapInArrow(run, schema), "__n_lines", "__n_dropped", "__kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark).insert(docs)
    out = index.digests(docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, n, i, parts[i] AS line FROM
             (SELECT doc_id, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
a AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, a.keeper IS NOT NULL AND k.doc_id <> a.keeper AS gone FROM k LEFT JOIN a USING (key))
SELECT doc_id, max(n) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
