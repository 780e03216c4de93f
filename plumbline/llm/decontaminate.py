"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, not characters.  Every 13-word window of a benchmark
item is a pattern; an item of fewer words is one pattern.  Patterns of one
length form a group with

* a SHIFT table over blocks of two words (one word for one-word patterns):
  how far the search may jump when it sees this block at the window's end,
* hash buckets by the suffix block, holding the test strings, and
* a direct comparison that confirms each occurrence.

Unseen blocks jump the whole window, so a clean document costs about one
lookup for every twelve words.

Benchmark items may be many.  Their windows are taken in blocks of at most
``block_windows``, which bounds the tables that a task holds (some 600 bytes a
window); a longer item is cut into pieces that overlap by a window less one
word.  Each block searches all documents; as hits follow from a text alone,
those of the second and later blocks are merged by the text's digest.  Any
number of items is searched exactly, and any number of blocks gives the same.

Defined cases: a null or empty text has no words, no hit, and the digest of
the empty list.  An item without words matches nothing.  An item whose id is
null marks words, but isn't counted or listed.  Repeated items and repeated
rows each give the same result as one, and rows that share an id or have none
are told apart.  Ids may be of any type.  Extra columns pass through the stage
whatever their names; in :func:`find_contamination` and :func:`contamination`
a result column takes the place of a caller's of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Held, free_worker, small_batches, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_find_words = re.compile(WORD).findall
_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return _find_words(text.translate(_LOWER)) if text else []


class Group:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, 2 if length > 1 else 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], tuple | set]] = {}

    def add(self, pattern: tuple[str, ...], item) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            block, jump = pattern[end - b : end], m - end
            self.shift[block] = min(jump, self.shift.get(block, m - b + 1))
        strings = self.buckets.setdefault(pattern[m - b :], {})
        known = strings.get(pattern, ())
        if isinstance(known, set):
            known.add(item)
        elif item not in known:  # few items have most strings; a tuple is smaller than a set
            strings[pattern] = (*known, item) if len(known) < 8 else {*known, item}

    def search(self, text: list[str]) -> Iterator[tuple[int, tuple | set]]:
        """(start, items) of each occurrence."""
        m, b, n, shift = self.length, self.block, len(text), self.shift
        most = m - b + 1
        end = m
        while end <= n:
            block = tuple(text[end - b : end])
            jump = shift.get(block, most)
            if jump:
                end += jump
                continue
            found = self.buckets[block].get(tuple(text[end - m : end]))
            if found is not None:
                yield end - m, found
            end += 1


class WuManber:
    """All groups of a block of benchmark items, given as (item, words)."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int = 13):
        self.groups: dict[int, Group] = {}
        for item, w in items:
            m = min(window, len(w))
            if m:
                group = self.groups.setdefault(m, Group(m))
                for i in range(len(w) - m + 1):
                    group.add(tuple(w[i : i + m]), item)

    def search(self, text: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) word spans that are hit, and the items found."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        for m, group in self.groups.items():
            for start, found in group.search(text):
                spans.append((start, start + m))
                items.update(found)
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Blocks of (item, words) of at most ``block_windows`` windows, one at a time."""
    block: list[tuple[object, list[str]]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    for i, t in rows.toLocalIterator():
        w = words(t)
        for at in range(0, max(1, len(w) - window + 1), block_windows):
            piece = w[at : at + block_windows + window - 1]
            n = max(1, len(piece) - window + 1)
            if block and size + n > block_windows:
                yield block
                block, size = [], 0
            block.append((i, piece))
            size += n
    yield block


def _searcher(tables, text_at: int):
    def run(batches):
        free_worker()
        find = tables.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(text_at).to_pylist():
                w = words(text)
                hit, found = find.search(w) if w else ([], set())
                n_words.append(len(w))
                spans.append([x for s in hit for x in s])
                items.append(sorted(str(x) for x in found if x is not None))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names, "__n_words", "__spans", "__items"],
            )

    return run


_EXTRA = "__n_words bigint, __spans array<bigint>, __items array<string>"


def _with(docs: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, *T._parse_datatype_string(_EXTRA).fields])


def _found(held: Held, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_windows: int) -> DataFrame:
    spark, text = held.df.sparkSession, held[text_col]
    blocks = item_blocks(benchmark, item_col, item_text_col, window, block_windows)
    schema = _with(held.df)
    out = held.df.mapInArrow(_searcher(spark.sparkContext.broadcast(WuManber(next(blocks), window)), held.inner.index(text)), schema)
    more = None
    for block in blocks:
        tables = spark.sparkContext.broadcast(WuManber(block, window))
        slim = held.df.select(F.col(text).alias("__text"))
        hits = slim.mapInArrow(_searcher(tables, 0), _with(slim)).where(F.size("__spans") > 0)
        hits = written(hits.select(F.sha2("__text", 256).alias("__digest"), "__spans", "__items").dropDuplicates(["__digest"]), "leak-hits")
        tables.destroy()
        more = hits if more is None else more.unionByName(hits)
    if more is None:
        return out
    merged = more.groupBy("__digest").agg(F.flatten(F.collect_list("__spans")).alias("__more_spans"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__more_items"))
    joined = out.join(merged, F.sha2(text, 256) == merged["__digest"], "left")
    none_l, none_s = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return joined.select(*held.inner, "__n_words", F.concat("__spans", F.coalesce("__more_spans", none_l)).alias("__spans"), F.array_sort(F.array_union("__items", F.coalesce("__more_items", none_s))).alias("__items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_windows: int = 200_000) -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` (flat [start, end) word offsets hit) and ``__items`` (ids as sorted strings).

    One pass without a shuffle while the windows fit one block.
    """
    held = Held(docs)
    return held.back(_found(held, benchmark, text_col, item_col, item_text_col, window, block_windows), "__n_words", "__spans", "__items")


def hit_words(spans) -> F.Column:
    """Number of words inside flat, possibly overlapping [start, end) spans."""
    pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(spans), 1) - 1), lambda i: F.struct(F.element_at(spans, 2 * i + 1).alias("s"), F.element_at(spans, 2 * i + 2).alias("e")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["e"] - F.greatest(p["s"], a["at"]))).alias("n"), F.greatest(a["at"], p["e"]).alias("at"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(F.array_sort(pairs), start, step)["n"])


def _judged(held: Held, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_windows: int = 200_000) -> DataFrame:
    found = _found(held, benchmark, text_col, item_col, item_text_col, window, block_windows)
    out = found.select(*held.inner, "__n_words", hit_words(F.col("__spans")).alias("__n_hit"), "__items")
    return out.withColumn("__contaminated", (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``__n_words``, ``__n_hit``, ``__items`` and ``__contaminated``."""
    held = Held(docs)
    return held.back(_judged(held, benchmark, **options), "__n_words", "__n_hit", "__items", "__contaminated")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        F.col("__contaminated").alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with any occurrence go, also where it is a small part of a long text."""
    small_batches(spark)
    held = Held(docs)
    return held.back(_judged(held, table(spark, sf_dir, "benchmark")).where(F.col("__n_hit") == 0))


_SQL_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS.format(t="text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
b AS (SELECT item_id, coalesce({_SQL_WORDS.format(t="text")}, CAST([] AS VARCHAR[])) AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
pats AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p
         FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT m FROM pats),
wins AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hits AS (SELECT DISTINCT wins.doc_id, wins.m, wins.i, pats.item_id FROM wins JOIN pats ON wins.m = pats.m AND wins.p = pats.p),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
