"""SimHash near-dedup with anchor points of a covering code.

Fingerprints are 64 bits, by majority over the XXH64 of word shingles.  Equal
fingerprints collapse first, so a group of copies is one node whatever its
size; a node is the smallest doc_id that has the fingerprint.

Links (2 or fewer differing bits) come from anchors.  The anchors are the
words of a covering code: the direct product of two perfect binary Golay codes
[23,12] on bits 0-22 and 23-45, covering radius 3 each, 2^24 anchors.  A
fingerprint is at home at its nearest anchor and is replicated to every anchor
that a fingerprint within the threshold of it can call home: those within
radius + threshold, where the threshold is shared out over both halves (3+2
and 3, 3+1 and 3+1, 3 and 3+2), about 61.  So two linked fingerprints meet at
the home anchor of either.  An anchor then compares its home fingerprints with
its replicas, and of the links it finds it keeps a spanning forest: no link is
lost for the components, and no group gives all its pairs.

An anchor with many home fingerprints is cut into slices of at most
``home_limit`` of them; its replicas go to every slice.  A task holds one
slice and streams the replicas past it, so its memory is bounded whatever the
group's size.

Components are contracted by large-star/small-star rounds over written tables;
each round's plan is a few joins and partial minima.

Defined cases: null or empty texts, and texts of white space, have fingerprint
zero and link like any other.  A null doc_id gets the component of its
fingerprint, null if no id is in it.  Repeated rows give one row each; the
pipeline stage keeps one of them.  Ids are whole numbers.  Extra columns pass
through the stage whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Held, drop_path, free_worker, only_ids, shared_dir, shuffle_partitions, small_batches, table, text_bytes, without_ids, written, written_at

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GOLAY = 0b110001110101
N_BITS, CHECK_BITS = 23, 11
THRESHOLD = 2


def _hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of a text in order, repeats included; of fewer words the whole."""
    words = text_bytes(text).lower().split()  # of bytes: ASCII white space and A-Z only
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(joined, seed)] if words else [], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)


def _majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of hashes: the bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for block in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[block : block + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    return _majority(_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, fp) of each row; fp as a signed bigint with the same bits."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), text_col).mapInArrow(run, "doc bigint, fp bigint")


@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndromes of all 23-bit words, and error patterns by syndrome and spare distance.

    ``near[d][s]`` lists the error patterns of weight 3 + d or less with
    syndrome s, padded with -1: word xor pattern is then a code word, that is
    an anchor within 3 + d.
    """
    syndrome = np.zeros(1 << N_BITS, np.int16)
    for bit in range(N_BITS):  # linear: that of a word is that of its highest bit xor that of the rest
        of_bit = 1 << bit
        for high in range(bit, CHECK_BITS - 1, -1):
            if of_bit >> high & 1:
                of_bit ^= GOLAY << (high - CHECK_BITS)
        syndrome[1 << bit : 2 << bit] = syndrome[: 1 << bit] ^ np.int16(of_bit)
    weight = np.zeros(1 << N_BITS, np.uint8)
    for bit in range(N_BITS):
        weight[1 << bit : 2 << bit] = weight[: 1 << bit] + 1
    near = []
    for d in range(THRESHOLD + 1):
        words = np.flatnonzero(weight <= 3 + d)
        order = words[np.lexsort((words, weight[words], syndrome[words]))]
        s = syndrome[order]
        first = np.r_[True, s[1:] != s[:-1]]
        rank = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        made = np.full((1 << CHECK_BITS, rank.max() + 1), -1, np.int32)
        made[s, rank] = order
        near.append(made)
    return syndrome, near


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, is its home) for every anchor of an array of fingerprints."""
    syndrome, near = _tables()
    u = fps.view(np.uint64)
    halves = [((u >> np.uint64(shift)) & np.uint64((1 << N_BITS) - 1)).astype(np.int64) for shift in (0, N_BITS)]
    rings = []  # per half and spare distance: code words, -1 where none
    for w in halves:
        s = syndrome[w]
        rings.append([np.where((e := near[d][s]) >= 0, w[:, None] ^ e, -1) for d in range(THRESHOLD + 1)])
    home = rings[0][0][:, 0] | (rings[1][0][:, 0] << N_BITS)
    out = []
    index = np.arange(len(u))
    for d in range(THRESHOLD + 1):
        a, b = rings[0][d], rings[1][THRESHOLD - d]
        both = np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), a[:, :, None] | (b[:, None, :] << N_BITS), -1).reshape(len(u), -1)
        i, j = np.nonzero(both >= 0)
        out.append(np.stack([index[i], both[i, j]], 1))
    pairs = np.concatenate(out)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    keep = np.r_[True, (pairs[1:] != pairs[:-1]).any(1)] if len(pairs) else np.zeros(0, bool)
    pairs = pairs[keep]
    return pairs[:, 0], pairs[:, 1], pairs[:, 1] == home[pairs[:, 0]]


def _replicate(batches):
    for batch in batches:
        node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for block in range(0, len(fp), 4096):
            i, anchor, home = anchors(fp[block : block + 4096].astype(np.int64))
            i = i + block
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(node[i]), pa.array(fp[i])], names=["anchor", "home", "node", "fp"])


class _Forest:
    """Union-find over small integers, smallest root first."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top and p != x:
            up[x] = top
            x = p
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(batches):
    """Rows sorted by (anchor, slice, home first): links of each slice as a spanning forest (a, b)."""
    key = None
    homes: list[tuple[np.ndarray, np.ndarray]] = []
    held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    forest = _Forest()
    for batch in batches:
        anchor, piece, home, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        fp = fp.astype(np.int64).view(np.uint64)
        links: list[tuple[int, int]] = []
        cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(piece) != 0)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(anchor)], strict=True):
            if start == end:
                continue
            if key != (anchor[start], piece[start]):
                key, homes, forest = (anchor[start], piece[start]), [], _Forest()
                held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            n_home = int(home[start:end].sum())  # home rows come first
            if n_home:
                homes.append((node[start : start + n_home], fp[start : start + n_home]))
                held = tuple(np.concatenate(x) for x in zip(*homes, strict=True))
                homes = [held]
            if not len(held[0]) or end - start < 2 and not len(held[0]) > 1:
                continue
            step = max(1, (1 << 22) // len(held[0]))
            for at in range(start, end, step):
                f, v = fp[at : min(at + step, end)], node[at : min(at + step, end)]
                i, j = np.nonzero(np.bitwise_count(f[:, None] ^ held[1][None, :]) <= THRESHOLD)
                apart = v[i] != held[0][j]
                for a, b in zip(v[i[apart]].tolist(), held[0][j[apart]].tolist(), strict=True):
                    if forest.join(a, b):
                        links.append((min(a, b), max(a, b)))
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(nodes: DataFrame, home_limit: int = 4096) -> DataFrame:
    """(a, b) node pairs, a < b, that connect all nodes whose fingerprints differ in 2 bits or fewer.

    ``nodes``: (node, fp), fingerprints distinct.
    """
    spark = nodes.sparkSession
    nodes = nodes.repartition(shuffle_partitions(spark), "fp")  # a node makes 61 rows: all cores make them
    placed = nodes.mapInArrow(_replicate, "anchor bigint, home boolean, node bigint, fp bigint")
    homes = nodes.mapInArrow(_homes, "anchor bigint")
    hot = homes.groupBy("anchor").count().where(F.col("count") > home_limit)
    hot = written(hot.select("anchor", F.ceil(F.col("count") / home_limit).alias("slices")), "simhash-hot")
    cut = placed.join(hot, "anchor", "left")
    # replicas go to every slice; a home row is at home in one slice and a replica in the others
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("slices"), F.lit(1)) - 1)
    rows = cut.select("anchor", F.explode(every).alias("slice"), "home", "node", "fp", "slices")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("slices"), F.lit(1)))
    rows = rows.select("anchor", "slice", (F.col("home") & (F.col("slice") == own)).alias("home"), "node", "fp")
    sorted_rows = rows.repartition(shuffle_partitions(spark), "anchor", "slice").sortWithinPartitions("anchor", "slice", F.col("home").desc())
    return sorted_rows.mapInArrow(_compare, "a bigint, b bigint").distinct()


def _homes(batches):
    syndrome, near = _tables()
    for batch in batches:
        u = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        parts = []
        for shift in (0, N_BITS):
            w = ((u >> np.uint64(shift)) & np.uint64((1 << N_BITS) - 1)).astype(np.int64)
            parts.append(w ^ near[0][syndrome[w], 0])
        yield pa.RecordBatch.from_arrays([pa.array(parts[0] | (parts[1] << N_BITS))], names=["anchor"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with an edge (a, b); component is the smallest node reachable.

    Large-star and small-star in turn, until no edge changes.
    """
    spark = edges.sparkSession
    edges, path = written_at(edges.where("a <> b").selectExpr("greatest(a, b) AS v", "least(a, b) AS u").distinct(), "stars")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above a node hang on the least of its neighbourhood
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").selectExpr("y AS v", "m AS u").distinct()
        # small star: neighbours below a node, and it, hang on the least of them
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").selectExpr("u AS v", "m AS u").where("v <> u").unionByName(below.selectExpr("v", "m AS u"))
        done = path
        edges, path = written_at(small.distinct(), "stars")
        drop_path(spark, done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, fp, component) of each row, in a table whose inputs are written."""
    spark = docs.sparkSession
    shared_dir(spark)
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc").alias("node")), "simhash-nodes")
    known = nodes.where(F.col("node").isNotNull()).select("node", "fp")
    comp = components(links(known))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "fp").select("doc", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The pipeline stage: words a shingle, least similarity.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8


def shingle_hashes(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, sorted; of fewer words the whole."""
    return np.unique(_hashes(text, shingle))


#: One document in so many is looked at for common shingles; how many of them are taken; members of a shared shingle up to which pairs are written; shingles of a slice's homes beyond.
LOOK, COMMON, COLD, SLICE = 16, 200_000, 64, 2_000_000


def _common(slim: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several documents of a small part share, sorted, and how many do.

    They only set the order in which shingles are tried, so any list is right.
    """

    def run(batches):
        free_worker()
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            h = [shingle_hashes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    part = slim.where(F.pmod(F.xxhash64("doc"), F.lit(LOOK)) == 0).mapInArrow(run, "h bigint")
    often = part.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = (often.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare ones ahead: sets of similarity 0.8 share one of them."""
    n = len(hashes)
    if not n:
        return hashes
    take, (known, counts) = n - (4 * n + 4) // 5 + 1, common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = np.where(known[at] == hashes, counts[at], 0)
        if often[:take].any():
            hashes = hashes[np.argsort(often, kind="stable")]
    return hashes[:take]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each value of the hashes' low bits, at least one a shingle: whether an odd number of shingles has it."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A number that two sets, given their parities, differ in at least."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _near(batches):
    """(a, b, sum of their sizes, parities) -> the pairs that may reach the similarity: at most a ninth of that sum may differ."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
        keep = pa.array([9 * least_difference(x, y) <= n for n, x, y in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of nodes those whose sizes and parities, some bits a shingle, don't rule the similarity out."""
    a, b = (nodes.select(F.col("doc").alias(c), F.col("size").alias(f"{c}_n"), F.col("parity").alias(f"{c}_bits")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").where(5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n"))
    both = both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "a_bits", "b_bits")
    return both.mapInArrow(_near, "a bigint, b bigint")


def _stage_prints(common):
    def run(batches):
        free_worker()
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(start, 1024)
                sizes, whole, fps, prefix, bits = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    every = _hashes(text, STAGE_SHINGLE)
                    h = np.unique(every)
                    sizes.append(len(h))
                    whole.append(xxhash.xxh3_128_digest(h.tobytes()))
                    fps.append(_majority(every))
                    prefix.append(_prefix(h, common.value).view(np.int64))
                    bits.append(parity(h))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(prefix, longs), pa.array(bits, pa.binary())], names=["doc", "size", "whole", "fp", "prefix", "parity"])

    return run


def _verify(batches):
    """(a, b, text of a, text of b) -> the pairs that reach the similarity on exact shingle sets."""
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        keep = []
        for x, y in ((batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) for i in range(batch.num_rows)):
            p, q = shingle_hashes(x), shingle_hashes(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= STAGE_SIMILARITY * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])


def _verified(pairs: DataFrame, slim: DataFrame, crowd: int = 256) -> DataFrame:
    """The pairs (a, b) of documents that reach the similarity, written; only texts in a pair are shuffled, and an ``a`` of many pairs is dealt out over salts."""
    spark = slim.sparkSession
    pairs, *paths = written_at(pairs, "near-pairs")
    wanted, path = written_at(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "near-wanted")
    texts, path_t = written_at(only_ids(slim, "doc", wanted), "near-pair-texts")
    hot, path_h = written_at(pairs.groupBy("a").count().where(F.col("count") > crowd).select("a", F.ceil(F.col("count") / crowd).alias("salts")), "near-crowds")
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    two = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("y")), "b").join(hot, "a", "left")
    two = two.select("a", F.pmod(F.xxhash64("b"), salts).alias("salt"), "b", "y")
    one = texts.select(F.col("doc").alias("a"), F.col("text").alias("x")).join(hot, "a", "left")
    one = one.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), "x")
    out = written(two.join(one, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint"), "near-links")
    for done in (*paths, path, path_t, path_h):
        drop_path(spark, done)
    return out


class _Slice:
    """Homes of a slice, with an index of their shingles; components already joined are not compared again."""

    def __init__(self, parts: list[tuple]):
        self.comp, self.size = (np.concatenate([p[i] for p in parts]) for i in range(2))
        sets = [s for p in parts for s in p[2]]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.root, self.forest = flat[order], owner[order], self.comp.copy(), _Forest()

    def join(self, comp: int, size: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        near = 5 * np.minimum(self.size, size) >= 4 * np.maximum(self.size, size)
        open_ = np.flatnonzero(near & (self.root != self.forest.root(comp)))
        if not len(open_):
            return []
        a, n = np.searchsorted(self.flat, hashes), np.searchsorted(self.flat, hashes, "right")
        n = n - a
        at_all = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.owner[at_all], minlength=len(self.comp))[open_]
        links = []
        for other in self.comp[open_[both >= STAGE_SIMILARITY * (self.size[open_] + size - both)]].tolist():
            if self.forest.join(comp, other):
                links.append((min(comp, other), max(comp, other)))
                roots = np.unique(self.root)
                self.root = np.array([self.forest.root(r) for r in roots.tolist()])[np.searchsorted(roots, self.root)]
        return links


def _resolve(batches):
    """Rows (shingle, slice, home, component, size, set) sorted, homes first: links between components, each row compared with all homes of its slice."""
    key, homes, made = None, [], None
    for batch in batches:
        token, piece, home, comp, size = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        sets = batch.column(5)
        cuts = np.flatnonzero((np.diff(token) != 0) | (np.diff(piece) != 0) | (np.diff(home) != 0)) + 1
        links: list[tuple[int, int]] = []
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(token)], strict=True):
            if start == end:
                continue
            if key != (token[start], piece[start]):
                key, homes, made = (token[start], piece[start]), [], None
            own = [sets[i].values.to_numpy(zero_copy_only=False) for i in range(start, end)]
            if home[start]:
                homes.append((comp[start:end], size[start:end], own))
            elif homes:
                made = made or _Slice(homes)
                for i, s in zip(range(start, end), own, strict=True):
                    links += made.join(int(comp[i]), int(size[i]), s)
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _sets(batches):
    for batch in batches:
        sets = [shingle_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "set"])


def _pairs(batches):
    """Rows (shingle, doc, component, size, place) sorted by shingle, few each: (a, b, sizes, places) of pairs of different components and of sizes that may reach the similarity."""
    left = None
    for batch in batches:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        now = now if left is None else np.concatenate([left, now], 1)
        cuts = np.flatnonzero(np.diff(now[0])) + 1
        done = cuts[-1] if len(cuts) else 0
        left = now[:, done:]
        yield _pairs_of(now[:, :done], cuts[:-1])
    if left is not None:
        yield _pairs_of(left, np.zeros(0, np.int64))


def _pairs_of(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    out = [np.zeros((6, 0), np.int64)]
    for g in np.split(rows, cuts, axis=1):
        g = g[:, np.argsort(g[1])]
        i, j = np.triu_indices(g.shape[1], 1)
        ok = (g[2][i] != g[2][j]) & (5 * np.minimum(g[3][i], g[3][j]) >= 4 * np.maximum(g[3][i], g[3][j]))
        i, j = i[ok], j[ok]
        out.append(np.stack([g[1][i], g[1][j], g[3][i], g[3][j], g[4][i], g[4][j]]))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], names=["a", "b", "a_size", "b_size", "a_at", "b_at"])


def _promising(nodes_of_tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shared prefix shingles, and all that may follow the last of them, can make up the similarity.

    A pair that shares a hot shingle as well is compared there, so of any other
    pair all shared prefix shingles are counted here.
    """
    spark = nodes_of_tokens.sparkSession
    dealt = nodes_of_tokens.repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token")
    rows = dealt.mapInArrow(_pairs, "a bigint, b bigint, a_size bigint, b_size bigint, a_at bigint, b_at bigint")
    per = rows.groupBy("a", "b", "a_size", "b_size").agg(F.count(F.lit(1)).alias("n"), F.max("a_at").alias("i"), F.max("b_at").alias("j"))
    most = F.col("n") + F.least(F.col("a_size") - F.col("i"), F.col("b_size") - F.col("j")) - 1
    return per.where(9 * most >= 4 * (F.col("a_size") + F.col("b_size"))).select("a", "b")


def _shared(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(token, k, doc, at, component, size) of the prefix shingles that nodes of different components share, written."""
    spark = nodes.sparkSession
    placed = nodes.select("doc", F.posexplode("prefix").alias("at", "token"))
    often = placed.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("k > 1")
    often, path = written_at(often, "near-shared")
    # few of all prefix rows are left: the rest of what is known of them comes by joins
    docs = often.select("doc").distinct()
    known = only_ids(nodes.select("doc", "size"), "doc", docs).join(joined, F.col("doc") == F.col("node"), "left").select("doc", "size", F.coalesce("component", "doc").alias("component"))
    full = often.join(known, "doc")
    ends = full.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    out = written(full.join(ends.select("token"), "token"), "near-open")
    drop_path(spark, path)
    return out


def _rest(nodes: DataFrame, joined: DataFrame, slim: DataFrame, cold: int = COLD, slice_: int = SLICE) -> DataFrame:
    """Links (a, b) between nodes of different components, so that with them no pair of similarity 0.8 is apart.

    Two such sets share a shingle of their prefixes.  Up to ``cold`` members of
    a shingle are paired and verified on their texts.  Beyond that, the sets of
    all members go past those of the members that aren't in the shingle's
    largest component, in slices of about ``slice_`` shingles of such homes.
    """
    spark = nodes.sparkSession
    shared = _shared(nodes, joined)
    found = _verified(_alike(_promising(shared.where(F.col("k") <= cold).select("token", "doc", "component", "size", "at")), nodes), slim)
    many = shared.where(F.col("k") > cold)
    if many.isEmpty():
        return found
    per = many.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    most = per.groupBy("token").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("s").alias("every"), F.max_by("s", F.struct("n", "component")).alias("most"))
    slices = most.select("token", F.col("top.component").alias("largest"), F.greatest(F.lit(1), F.ceil((F.col("every") - F.col("most")) / slice_)).cast("bigint").alias("slices"))
    hot = written(many.select("token", "doc", "component", "size").join(slices, "token"), "near-hot")
    sets = written(only_ids(slim, "doc", hot.select("doc").distinct()).mapInArrow(_sets, "doc bigint, set array<bigint>"), "near-sets")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)
    past = hot.select("token", F.explode(every).alias("slice"), F.lit(0).alias("home"), "doc", "component", "size")
    homes = hot.where(F.col("component") != F.col("largest")).select("token", F.pmod(F.xxhash64("doc"), "slices").alias("slice"), F.lit(1).alias("home"), "doc", "component", "size")
    rows = homes.unionByName(past).join(sets, "doc").select("token", "slice", "home", "component", "size", "set")
    dealt = rows.repartition(shuffle_partitions(spark), "token", "slice").sortWithinPartitions("token", "slice", F.desc("home"))
    return found.unionByName(dealt.mapInArrow(_resolve, "a bigint, b bigint").distinct())


def _one_text(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text), of an id with several rows the one whose text is first by hash; and those ids, None if there are none."""
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    again = slim.groupBy("doc").count().where("count > 1").select("doc")
    if again.isEmpty():
        return slim, None
    again = written(again, "near-again")
    first = only_ids(slim, "doc", again).withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text"))).where("nth = 1").drop("nth")
    return written(without_ids(slim, "doc", again).unionByName(first), "near-texts"), again


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc, component): groups of documents linked by a similarity of 0.8 or more of their sets of five-word shingles, no link left out.

    Equal shingle sets collapse first.  SimHashes of all shingles are then linked
    at their anchors, as in :func:`near_duplicates`, and the linked documents are
    verified on the exact sets.  As the threshold of 2 bits, and the forests that
    :func:`links` keeps, don't hold all pairs of the similarity, what is left
    apart is searched exactly: see :func:`_rest`.  Of an id with several texts
    the one that the stage keeps counts.
    """
    return _grouped(_one_text(docs, id_col, text_col)[0], **limits)


def _linked(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (doc, fp): equal fingerprints with the smallest id that has them, and those that meet at anchors."""
    least, path = written_at(nodes.groupBy("fp").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("k")), "near-fingerprints")
    shared = least.where("k > 1").select("fp", F.col("node").alias("a"))
    equal = nodes.select("fp", F.col("doc").alias("b")).join(shared, "fp").where("a <> b").select("a", "b")
    out = written(equal.unionByName(links(least.select("node", "fp"))), "near-linked")
    drop_path(nodes.sparkSession, path)
    return out


def _grouped(slim: DataFrame, **limits) -> DataFrame:
    common = slim.sparkSession.sparkContext.broadcast(_common(slim))
    prints = written(slim.mapInArrow(_stage_prints(common), "doc bigint, size bigint, whole binary, fp bigint, prefix array<bigint>, parity binary"), "near-prints")
    least = prints.groupBy("whole").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    copies = written(prints.select("doc", "whole").join(least, "whole").where("doc <> rep").select("doc", "rep"), "near-copies")
    nodes = without_ids(prints.select("doc", "size", "fp", "prefix", "parity"), "doc", copies)
    joined = components(_verified(_alike(_linked(nodes.where("size > 0").select("doc", "fp")), nodes), slim))
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_rest(nodes, joined, slim, **limits))
    ends = components(links)
    named = prints.select("doc").join(copies, "doc", "left").select("doc", F.coalesce("rep", "doc").alias("rep"))
    return named.join(ends, named["rep"] == ends["node"], "left").select("doc", F.coalesce("component", "rep").alias("component"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of similar documents the one with the smallest id stays; rows without an id stay."""
    shared_dir(spark)
    small_batches(spark)
    held = Held(docs)
    ident, text = held["doc_id"], held["text"]
    slim, again = _one_text(held.df, ident, text)
    gone = written(_grouped(slim).where(F.col("doc") != F.col("component")).select("doc"), "near-gone")
    number = F.col(ident).cast("bigint")
    kept = without_ids(held.df.withColumn("__doc", number), "__doc", gone)
    if again is None:
        return held.back(kept)
    same_id = Window.partitionBy("__doc").orderBy(F.xxhash64(text), text)
    first = only_ids(kept, "__doc", again).withColumn("__nth", F.row_number().over(same_id)).where("__nth = 1").drop("__nth")
    return held.back(without_ids(kept, "__doc", again).unionByName(first))
