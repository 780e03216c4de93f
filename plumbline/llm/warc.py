"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id and sorted inside.  The
bounds cut the ids into about equal sums of payload bytes, found from exact
sums over bins of the ids, and the number of shards follows from all payload
bytes alone: ``shard_bytes`` each, more where that made over ``MOST_SHARDS``.
One task writes one shard, as gzip members, one a record, with headers and
digests made anew, and rolls to the next file once a file's compressed size
passes ``roll_bytes``.  Each file begins with a warcinfo record, is written
under a temporary name of its own attempt, gets its final name when it is
whole, and is named by shard, sequence and digest of its bytes.  Names and
bytes depend only on the records and these parameters, not on the session, so
a task that runs twice (retry, speculation) ends in equal files.  The manifest,
written last through Spark's commit, lists files with sizes, record counts and
digests; readers trust only what it lists, so leftovers of dead attempts are
never read.

A response's block is an HTTP response (status line, type and length, then the
payload), a revisit's its head alone.  Block digests are over the block,
payload digests over the payload.

Payloads that occur more than once are stored once: the record with the
largest id is the response, the others are revisits that refer to it.  Who
that is comes from a sum over (digest, length, second hash) with partial
maxima before the shuffle; the payloads themselves move once, to their shard.

Defined cases: a null payload is empty.  Ids are whole numbers over the whole
bigint range.  A record whose id is null is a response of its own, nothing
refers to it, and it lies in the first shard.  Records of equal id lie in one
shard; with equal payloads too they are alike: all responses if that id is the
largest, else all revisits.  An empty table makes no file and an empty
manifest.  A null url becomes an empty target, control characters in one go.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import commit_file, filesystem, scratch, shared_dir, shuffle_partitions, table, text_bytes, written

#: Fixed date of all records: archives of equal records are equal byte for byte.
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, and the number of shards from which on shards grow instead.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 20_000


def record_id(key: str) -> str:
    """A URN that depends on the record's id alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[str], block: bytes) -> bytes:
    """A record as one gzip member, whose bytes depend on the record alone: its head has no time or system."""
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def make_info(shard: int, seq: int) -> bytes:
    """The warcinfo record that begins a file."""
    return _member(
        ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(f'info:{shard}:{seq}')}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"],
        b"software: plumbline\r\nformat: WARC File Format 1.1\r\n",
    )


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c for c in (url or "") if c >= " ")
    key = f"{page_id}" if page_id is not None else "null:" + digest32(payload + target.encode("utf-8", "surrogatepass"))
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(str(refers_to))}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _member(head, block)


def read_records(source):
    """(headers, block) of each record of an archive, in order, holding one record at a time."""
    pending = b""
    while True:
        member, raw = zlib.decompressobj(31), []
        while not member.eof:
            pending = pending or source.read(1 << 20)
            if not pending:
                if raw:
                    raise ValueError("archive ends inside a record")
                return
            raw.append(member.decompress(pending))
            pending = member.unused_data
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, rest[:size]


_MANIFEST = "shard int, seq int, file string, bytes bigint, records bigint, sha256 string"


def _write_shards(folder: str, roll_bytes: int):
    """(shard, id, sha, refers_to, url, html), sorted, a marker ahead of what it marks -> manifest rows."""

    def run(batches):
        fs, base = filesystem(folder)
        shard, seq, sink, temp, size, count, digest = None, 0, None, "", 0, 0, None
        marked, refers = None, None

        def close():
            sink.close()
            sha = digest.hexdigest()
            name = f"part-{shard:06d}-{seq:05d}-{sha[:16]}.warc.gz"
            commit_file(fs, temp, f"{base}/{name}")
            return [shard, seq, name, size, count, sha]

        for batch in batches:
            done = []
            for s, page, sha, mark, url, html in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if mark is not None:
                    marked, refers = (page, sha), mark
                    continue
                if sink is not None and (s != shard or size >= roll_bytes):
                    done.append(close())
                    sink, seq = None, seq + 1
                if s != shard:
                    shard, seq = s, 0
                if sink is None:
                    temp = f"{base}/.part-{shard:06d}-{seq:05d}.{uuid.uuid4().hex}"
                    info = make_info(shard, seq)
                    sink, size, count, digest = fs.open_output_stream(temp, compression=None), len(info), 0, hashlib.sha256(info)
                    sink.write(info)
                record = make_record(page, url, text_bytes(html), refers if marked == (page, sha) else None)
                sink.write(record)
                digest.update(record)
                size, count = size + len(record), count + 1
            if done:
                yield _manifest_batch(done)
        if sink is not None:
            yield _manifest_batch([close()])

    return run


def _manifest_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "seq", "file", "bytes", "records", "sha256"])


def _bounds(sizes: DataFrame, share: int, bins: int = 1024) -> list[int]:
    """Distinct inner bounds that cut the ids of an (id, n) table into ranges of about ``share`` bytes; they depend on the table alone.

    Exact sums over equal-width bins give the cuts; a bin with more than a
    share is binned again, down to one id.  A round sends at most ``bins`` rows
    of each bin that it cuts to the driver.  Arithmetic is in decimals, which
    hold any difference of two bigints.
    """
    wide = sizes.where(F.col("id").isNotNull()).select("id", F.col("id").cast("decimal(20,0)").alias("w"), "n")
    low, high, total = wide.agg(F.min("id"), F.max("id"), F.sum("n")).first()
    if low is None or low == high or total <= share:
        return []
    done: list[tuple[int, int]] = []  # (last id, bytes)
    todo = [(low, high)]
    while todo:
        widths = [(lo, hi, max(1, -(-(hi - lo + 1) // bins))) for lo, hi in todo]
        cuts = F.broadcast(wide.sparkSession.createDataFrame([(lo, hi, Decimal(lo), Decimal(w)) for lo, hi, w in widths], "lo bigint, hi bigint, from decimal(20,0), width decimal(20,0)"))  # at most a row a shard
        inside = wide.join(cuts, F.col("id").between(F.col("lo"), F.col("hi"))).select("lo", F.expr("(w - from) div width").alias("bin"), "n")
        found = inside.groupBy("lo", "bin").agg(F.sum("n").alias("n")).collect()
        width, end = {lo: w for lo, _, w in widths}, {lo: hi for lo, hi, _ in widths}
        todo = []
        for lo, i, n in found:
            at = lo + i * width[lo]
            last = min(end[lo], at + width[lo] - 1)
            if n > share and width[lo] > 1:
                todo.append((at, last))
            else:
                done.append((last, n))
    out, held = [], 0
    for last, n in sorted(done):
        if held and held + n > share:
            out.append(before)
            held = 0
        held, before = held + n, last
    return [x for x in out if x < high]


def _shard_of(bounds: list[int], ident):
    """Number of bounds below an id, in two steps so that a row is compared with few of them."""
    if not bounds:
        return F.lit(0)
    size = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    literal = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda x: x < ident))
    group = below(literal([g[-1] for g in groups]))  # groups wholly below
    inner = below(F.get(F.array(*[literal(g) for g in groups]), group))
    return F.coalesce(F.when(group < len(groups), group * size + inner).otherwise(len(bounds)), F.lit(0)).cast("int")


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as an archive below ``folder``; its manifest, as read back.

    Payloads of fewer than ``revisit_from`` bytes are always responses.
    """
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/records")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("bigint").alias("id"), F.sha1(raw).alias("sha"), F.xxhash64(raw).alias("x"), F.length(raw).cast("bigint").alias("n"))
    keys = written(slim, "warc-keys")  # some 70 bytes a record, payloads stay out
    groups = keys.where(F.col("id").isNotNull() & (F.col("n") >= revisit_from)).groupBy("sha", "x", "n").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    revisits = keys.join(groups, ["sha", "x", "n"]).where("id < last").groupBy("id", "sha").agg(F.max("last").alias("refers_to"))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bounds = _bounds(keys.groupBy("id").agg(F.sum(F.col("n") + 512).alias("n")), max(shard_bytes, -(-total // MOST_SHARDS)))
    shard = lambda c: _shard_of(bounds, c)
    # a marker row goes ahead of each record that is a revisit: payloads move once, to their shard
    ident = F.col(id_col).cast("bigint")
    records = pages.select(shard(ident).alias("shard"), ident.alias("id"), F.sha1(raw).alias("sha"), F.lit(None).cast("bigint").alias("refers_to"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    nothing = F.lit(None).cast("string")
    markers = revisits.select(shard(F.col("id")).alias("shard"), "id", "sha", "refers_to", nothing.alias("url"), nothing.alias("html"))
    dealt = records.unionByName(markers).repartitionById(len(bounds) + 1, "shard")
    sorted_ = dealt.sortWithinPartitions("shard", "id", "sha", F.col("refers_to").desc_nulls_last(), "url")
    sorted_.mapInArrow(_write_shards(f"{folder}/records", roll_bytes), _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read_files(folder: str):
    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for name, records, sha in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, size, seen, digest = [], 0, 0, hashlib.sha256()
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    tee = _Hashing(source, digest)
                    for h, whole in read_records(tee):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        seen += 1
                        payload = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        http, _, block = whole.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if h["WARC-Block-Digest"] != "sha1:" + digest32(whole) or h["WARC-Type"] == "response" and (digest32(block) != payload or len(block) != n):
                            raise ValueError(f"{name}: digest of {h['WARC-Record-ID']} doesn't match")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        rows.append((number("X-Page-Id"), h["WARC-Target-URI"], block, n, payload, h["WARC-Type"], number("X-Refers-To-Page-Id")))
                        size += len(block) + 200
                        if size > 8 << 20:
                            yield _record_batch(rows)
                            rows, size = [], 0
                if seen != records or digest.hexdigest() != sha:
                    raise ValueError(f"{name} doesn't match the manifest")
                if rows:
                    yield _record_batch(rows)

    return run


class _Hashing(io.RawIOBase):
    def __init__(self, source, digest):
        self.source, self.digest = source, digest

    def read(self, n=-1):
        got = self.source.read(n)
        self.digest.update(got)
        return got


_RECORDS = "page_id bigint, url string, block binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _record_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "block", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All records of an archive; files are streamed, and checked against headers and manifest."""
    files = spark.read.parquet(f"{folder}/manifest").select("file", "records", "sha256")
    return files.repartition(shuffle_partitions(spark), "file").mapInArrow(_read_files(f"{folder}/records"), _RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    folder = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
