"""Content-addressed store of token ids.

A document's id stream ends with the end id.  A rolling hash over sixteen ids
cuts it into chunks wherever the hash hits a mask, so equal passages cut alike
wherever they stand.  A chunk's address is a 128-bit hash of its ids; every
unique chunk is stored once.

Files of a store:

* ``packs/pack-<partition>-<n>.bin``: chunk payloads, ids as little-endian
  16-bit words (32-bit where the vocabulary needs it), zstd-compressed one by
  one, in order of address.  A pack is written under a temporary name and
  renamed when it is whole; names and bytes depend only on its contents, so a
  task that is run again writes the same files.
* ``index``: address, pack, offset, length of each stored chunk.
* ``recipes``: per document its id, place in the stream (``start``), number of
  ids, addresses in order and Merkle root, range-sorted by doc_id.
* ``manifest``: per recipe part its number of documents and ids and the Merkle
  root over its documents' roots.

Reading back opens every pack once, decompresses each chunk, checks it against
its address and takes its length and CRC.  A document's CRC is combined from
those of its chunks in recipe order (CRC-32 of a concatenation follows from the
parts), and its Merkle root and number of ids must agree with the recipe.

Ids come from the tokenizers library.  Its byte-level splitting never joins
text across a change from non-space to a space or line end, or from a letter
to an ASCII mark or digit, so texts are cut there, by Arrow kernels, and each
different piece is encoded once; texts with other white space or with a
special token's string are encoded whole.

Defined cases: a null or empty text is the end id alone.  Null doc_ids sort
first.  Rows of equal doc_id follow in order of their Merkle roots.  Extra
columns are ignored.  An empty table makes an empty store.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import commit_file, filesystem, free_worker, scratch, shuffle_partitions, small_batches, table

END_ID = 2
WINDOW, MASK_BITS, MIN_CHUNK, MAX_CHUNK = 16, 10, 128, 8192
PACK_BYTES = 32 << 20
CACHE_PIECES = 300_000
#: Pieces that are encoded in one call; ids whose rolling hash is taken at once.
BLOCK_PIECES, HASHED = 2000, 1 << 18
#: Documents whose pieces are looked up at once.
DOCS = 512

#: Cut mark, and where a letter (of ASCII or Latin-1) meets an ASCII mark or digit other than the apostrophe.
_CUT = "\x01"
_LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-@\[-`{-~])"
#: Texts encoded whole: with the cut mark, white space ahead of a space or line end, or white space beyond ASCII's.
_UNCUT = r"\x01|[\t-\r ][ \n]|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _tokenizer(path: str):
    """One tokenizer a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Text -> little-endian ids as bytes (16 bits each, 32 where the vocabulary needs it), through a bounded cache.

    The cache is an Arrow array of pieces with their ids in one buffer, some 30
    bytes a piece.  Beyond ``CACHE_PIECES`` the half that was asked for last stays.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = "|".join([_UNCUT, *special])
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.known = pa.array([], pa.string())
        self.ids, self.sizes, self.asked = np.zeros(0, self.kind), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.batches = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring_regex(texts.filter(pa.array(~whole)), _LETTER_MARK, rf"\1{_CUT}\2")
        for c in " \n":
            marked = pc.replace_substring(marked, c, _CUT + c)
        pieces = pc.split_pattern(marked, _CUT)
        coded = pieces.flatten().dictionary_encode()
        ids, sizes, starts = self._ids(coded.dictionary)
        # ids of all pieces in order: each piece is a run in the ids of the different pieces
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(ids)) < 2**31 else np.int64
        place = np.repeat((starts[at] - ends + lengths).astype(kind), lengths)
        place += np.arange(total, dtype=kind)
        flat = ids[place].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))]] * ids.itemsize
        cut = iter([flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        return [self._whole(texts[i].as_py()) if w else next(cut) for i, w in enumerate(whole.tolist())]

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A buffer of ids, and where in it those of each of the different pieces are: their number and the first one's place."""
        self.batches += 1
        if len(self.known) > CACHE_PIECES:
            self._forget()
        at = pc.index_in(pieces, self.known)
        new = pieces.filter(at.is_null())
        ids, sizes = self._encoded(new.to_pylist())
        at = at.to_numpy(zero_copy_only=False)
        hole = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        place = np.empty(len(at), np.int64)
        place[~hole] = at[~hole]
        place[hole] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.asked = np.concatenate([self.asked, np.zeros(len(new), np.int32)])
        self.asked[place] = self.batches
        return self.ids, self.sizes[place].astype(np.int64), (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[place]

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.asked, kind="stable")[: CACHE_PIECES // 2])
        kept = np.zeros(len(self.known), bool)
        kept[keep] = True
        self.known = self.known.take(pa.array(keep))
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.sizes, self.asked = self.sizes[keep], self.asked[keep]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and their numbers.

        A block of pieces goes as words of one sequence, which the tokenizer
        splits and merges one by one, as it would texts of their own.
        """
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int32)]
        for at in range(0, len(pieces), BLOCK_PIECES):
            block = pieces[at : at + BLOCK_PIECES]
            coded = self.tokenizer.encode(block, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(coded.ids, self.kind))
            sizes.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(block)).astype(np.int32))
        return np.concatenate(ids), np.concatenate(sizes)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process; its cache outlives tasks."""
    return Encoder(path)


@functools.cache
def _gear(n: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 1 << 63, n, dtype=np.uint64)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash allows a cut, over a batch of streams."""
    gear, out = _gear(), [np.zeros(0, np.int64)]
    for at in range(0, len(ids), HASHED):
        begin = max(0, at - WINDOW + 1)  # so that whole windows end at the part's ids
        h = gear[ids[begin : at + HASHED] & 0xFFFF]
        width = 1
        while width < WINDOW:
            shifted = np.zeros_like(h)
            shifted[width:] = h[:-width]
            shifted <<= np.uint64(width)
            h += shifted
            width *= 2
        h = h[at - begin :]
        out.append(np.flatnonzero((h >> np.uint64(63 - MASK_BITS)) & np.uint64((1 << MASK_BITS) - 1) == 0) + at + 1)
    return np.concatenate(out)


def chunk_ends(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the stream [start, end) among candidate cuts.

    A window lies inside the stream for every cut used, since chunks have more
    ids than it.
    """
    out, at = [], start
    inside = cuts[np.searchsorted(cuts, start + MIN_CHUNK) : np.searchsorted(cuts, end)].tolist()
    for cut in inside:
        while cut - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        if cut - at >= MIN_CHUNK:
            out.append(cut)
            at = cut
    while end - at > MAX_CHUNK:
        at += MAX_CHUNK
        out.append(at)
    out.append(end)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves; an odd one out goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [xxhash.xxh3_128_digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Merkle:
    """:func:`merkle` of leaves that come one by one, holding a node a level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []  # (height, hash), heights falling

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.nodes and self.nodes[-1][0] == height:
            leaf, height = xxhash.xxh3_128_digest(b"\x01" + self.nodes.pop()[1] + leaf), height + 1
        self.nodes.append((height, leaf))

    def root(self) -> bytes:
        if not self.nodes:
            return b""
        out = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            out = xxhash.xxh3_128_digest(b"\x01" + left + out)
        return out


def _gf2_times(matrix: list[int], vec: int) -> int:
    out, i = 0, 0
    while vec:
        if vec & 1:
            out ^= matrix[i]
        vec >>= 1
        i += 1
    return out


@functools.cache
def _zero_operator(k: int) -> tuple[tuple[int, ...], ...]:
    """Byte tables of the operator that appends 2^k zero bytes to a CRC-32 register."""
    if k == 0:
        one = [0xEDB88320, *(1 << i for i in range(31))]  # a zero bit
        for _ in range(3):
            one = [_gf2_times(one, x) for x in one]
        matrix = one
    else:
        before = _zero_operator(k - 1)
        matrix = [_apply(before, _apply(before, 1 << i)) for i in range(32)]
    return tuple(tuple(_gf2_times(matrix, b << (8 * j)) for b in range(256)) for j in range(4))


def _apply(op: tuple[tuple[int, ...], ...], crc: int) -> int:
    return op[0][crc & 255] ^ op[1][crc >> 8 & 255] ^ op[2][crc >> 16 & 255] ^ op[3][crc >> 24]


def crc_combine(crc1: int, crc2: int, len2: int) -> int:
    """CRC-32 of a concatenation from those of its parts."""
    k = 0
    while len2:
        if len2 & 1:
            crc1 = _apply(_zero_operator(k), crc1)
        len2 >>= 1
        k += 1
    return crc1 ^ crc2


_ROWS = pa.schema([("address", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("addresses", pa.binary()), ("root", pa.binary())])
_ROWS_DDL = "address binary, payload binary, doc_id bigint, n_tokens bigint, addresses binary, root binary"


def _encode(path: str):
    """(doc_id, text) -> a recipe row a document, and a chunk row for each chunk that this task sees first."""

    def run(batches):
        free_worker(store_too=False)
        enc = encoder(path)
        width = 4 if enc.wide else 2
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
        seen: set[bytes] = set()
        end_id = np.array([END_ID], enc.kind).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), DOCS):
                streams = [s + end_id for s in enc.batch(texts.slice(at, DOCS))]
                raw = b"".join(streams)
                cuts = cut_points(np.frombuffer(raw, enc.kind))
                chunks, payloads, recipes = [], [], []
                start = 0
                for doc, s in zip(doc_ids[at : at + DOCS], streams, strict=True):
                    end = start + len(s) // width
                    own, begin = [], start
                    for stop in chunk_ends(cuts, start, end):
                        chunk = raw[width * begin : width * stop]
                        a = xxhash.xxh3_128_digest(chunk)
                        own.append(a)
                        if a not in seen:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add(a)
                            chunks.append(a)
                            payloads.append(squeeze(chunk))
                        begin = stop
                    recipes.append((doc, end - start, b"".join(own), merkle(own)))
                    start = end
                c, r = len(chunks), len(recipes)
                docs, counts, lists, roots = zip(*recipes, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*chunks, *[None] * r], pa.binary()),
                        pa.array([*payloads, *[None] * r], pa.binary()),
                        pa.array([*[None] * c, *docs], pa.int64()),
                        pa.array([*[None] * c, *counts], pa.int64()),
                        pa.array([*[None] * c, *lists], pa.binary()),
                        pa.array([*[None] * c, *roots], pa.binary()),
                    ],
                    schema=_ROWS,
                )

    return run


_INDEX_DDL = "address binary, pack string, at bigint, size bigint, doc_id bigint, n_tokens bigint, addresses binary, root binary"


def _pack(folder: str):
    """Chunk rows sorted by address -> packs and index rows; recipe rows pass through."""

    def run(batches):
        from pyspark import TaskContext

        free_worker()  # the encoder is done with
        fs, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        last, n, at, sink, temp, name = None, 0, 0, None, "", ""

        def close():
            sink.close()
            commit_file(fs, temp, f"{base}/{name}")

        for batch in batches:
            addresses, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            index: list[tuple[bytes, str, int, int]] = []
            recipes = []
            for i, (a, p) in enumerate(zip(addresses, payloads, strict=True)):
                if a is None:
                    recipes.append(i)
                    continue
                if a == last:
                    continue
                last = a
                if sink is not None and at >= PACK_BYTES:
                    close()
                    sink = None
                if sink is None:
                    name, n, at = f"pack-{part:06d}-{n:05d}.bin", n + 1, 0
                    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(temp, compression=None)
                sink.write(p)
                index.append((a, name, at, len(p)))
                at += len(p)
            k = len(index)
            passed = batch.take(pa.array(recipes, pa.int64()))
            a, names, places, sizes = zip(*index, strict=True) if index else ((), (), (), ())
            r = len(recipes)
            fill = lambda xs, kind: pa.array([*xs, *[None] * r], kind)
            yield pa.RecordBatch.from_arrays(
                [fill(a, pa.binary()), fill(names, pa.string()), fill(places, pa.int64()), fill(sizes, pa.int64()), *(pa.concat_arrays([pa.nulls(k, passed.column(j).type), passed.column(j)]) for j in range(2, 6))],
                names=["address", "pack", "at", "size", "doc_id", "n_tokens", "addresses", "root"],
            )
        if sink is not None:
            close()

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write a store below ``folder``."""
    spark = docs.sparkSession
    fs_jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/packs")
    fs_jvm.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs_jvm)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(_encode(tokenizer or default_tokenizer()), _ROWS_DDL)
    # chunks meet by address; recipes, which are small, are dealt evenly
    key = F.when(F.col("address").isNull(), F.xxhash64("doc_id", "root")).otherwise(F.xxhash64("address"))
    dealt = rows.withColumn("__key", key).repartition(shuffle_partitions(spark), "__key").sortWithinPartitions("address").drop("__key")
    dealt.mapInArrow(_pack(f"{folder}/packs"), _INDEX_DDL).write.parquet(f"{folder}/packed")

    packed = spark.read.parquet(f"{folder}/packed")
    recipes = packed.where(F.col("address").isNull()).select("doc_id", "n_tokens", "addresses", "root")
    ranged = recipes.repartitionByRange(shuffle_partitions(spark), "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ranged.select(F.spark_partition_id().alias("part"), "*").write.parquet(f"{folder}/sorted")
    manifest(spark, folder).write.parquet(f"{folder}/manifest")


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """(start, doc_id, n_tokens, addresses, root, part), start being unique since no document is without ids.

    Reading fails where a part's documents or ids aren't those of the manifest.
    """
    rows = spark.read.parquet(f"{folder}/sorted")
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    told = spark.read.parquet(f"{folder}/manifest").select("part", "documents", F.col("n_tokens").alias("tokens"))
    same = (F.col("k") == F.col("documents")) & (F.col("n") == F.col("tokens"))
    wrong = F.assert_true(F.coalesce(same, F.lit(False)), F.concat(F.lit("the manifest doesn't hold for part "), F.col("part").cast("string")))
    parts = parts.join(told, "part", "full").where(wrong.isNull()).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select("*", (inside - F.col("n_tokens")).alias("inside")).join(parts, "part")
    return placed.select((F.col("base") + F.col("inside")).alias("start"), "doc_id", "n_tokens", "addresses", "root", "part")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, documents, n_tokens, root) as the recipes have it: the root is the Merkle root over the documents' roots in order."""

    def run(batches):
        state = None
        for batch in batches:
            for part, n, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or state[0] != part:
                    if state is not None:
                        yield _manifest_row(state)
                    state = [part, 0, 0, Merkle()]
                state[1] += 1
                state[2] += n
                state[3].add(root)
        if state is not None:
            yield _manifest_row(state)

    rows = spark.read.parquet(f"{folder}/sorted").select("part", "doc_id", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "doc_id", "root")
    return rows.select("part", "n_tokens", "root").mapInArrow(run, "part int, documents bigint, n_tokens bigint, root binary")


def _manifest_row(state) -> pa.RecordBatch:
    part, docs, n, tree = state
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([n], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "documents", "n_tokens", "root"])


def verify(spark: SparkSession, folder: str) -> bool:
    """Whether the recipes still have the Merkle roots that the manifest states."""
    return spark.read.parquet(f"{folder}/manifest").exceptAll(manifest(spark, folder)).isEmpty()


def _read_packs(folder: str, pack: str):
    """(pack, chunks sorted by place) -> (address, n, crc) of each chunk as read from its file."""

    def run(batches):
        fs, base = filesystem(folder)
        opened, source = None, None
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out_n, out_crc = [], []
            for name, a, at, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != opened:
                    opened, source = name, fs.open_input_file(f"{base}/{name}")
                source.seek(at)
                stored = unzip(source.read(size))
                ids = np.frombuffer(stored, pack)
                if xxhash.xxh3_128_digest(stored) != a:
                    raise ValueError(f"chunk {a.hex()} in {name} at {at} doesn't match its address")
                out_n.append(len(ids))
                out_crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out_n, pa.int64()), pa.array(out_crc, pa.int64())], names=["address", "n", "crc"])

    return run


def _assemble(batches):
    """(start, nth, address, n, crc, doc_id, n_tokens, root, size), sorted by start and nth -> documents."""
    now, leaves, count, crc = None, [], 0, 0
    for batch in batches:
        done = []
        for start, a, n, c, doc, n_tokens, root, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8)), strict=True):
            if now != start:
                now, leaves, count, crc = start, [], 0, 0
            leaves.append(a)
            crc = c if count == 0 else crc_combine(crc, c, 4 * n)
            count += n
            if len(leaves) == size:
                if count != n_tokens or merkle(leaves) != root:
                    raise ValueError(f"document {doc} doesn't match its recipe")
                done.append((doc, start, count, crc))
        if done:
            cols = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the packs by the recipes."""
    n = shuffle_partitions(spark)
    index = spark.read.parquet(f"{folder}/packed").where(F.col("address").isNotNull())
    placed = index.select("pack", "address", "at", "size").repartition(n, "pack").sortWithinPartitions("pack", "at")
    chunks = placed.mapInArrow(_read_packs(f"{folder}/packs", "<u4" if wide else "<u2"), "address binary, n bigint, crc bigint")
    size = (F.length("addresses") / 16).cast("int")
    r = recipes(spark, folder).select("start", "doc_id", "n_tokens", "root", size.alias("size"), "addresses", F.posexplode(F.sequence(F.lit(0), size - 1)).alias("nth", "__at"))
    r = r.select("start", "nth", F.substring(F.col("addresses"), F.col("nth") * 16 + 1, F.lit(16)).alias("address"), "doc_id", "n_tokens", "root", "size")
    whole = r.join(chunks, "address", "left").select("start", "nth", "address", "n", "crc", "doc_id", "n_tokens", "root", "size")
    return whole.repartition(n, "start").sortWithinPartitions("start", "nth").mapInArrow(_assemble, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "token-store")
    write_store(docs, folder)
    return read_store(spark, folder, encoder(default_tokenizer()).wide)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the store of all documents, as read back."""
    return store_and_read(docs)
