"""Exact top-k inner products by a Voronoi kNN join.

Vectors are whole numbers, floor(256 x) per component.  A bounded sample of
vectors serves as pivots, their number growing with the root of the vectors'
up to ``most_pivots``; every vector belongs to the cell of its nearest pivot.
One row of summary per (dimension, cell), its count, least and largest distance
from the pivot and largest norm, is all the planning needs.

Cells are packed into blocks of at most ``block_rows`` rows (a larger cell is
split by id hash).  A query is first solved in the block of its own cell: its
k-th best score there is real, so no candidate below it can matter.  Then it
goes to those other blocks that hold a cell whose bound reaches that score, the
bound being the least of three: by the ball around the pivot, and by the
distance that the triangle inequality, or the plane between the two pivots,
keeps between query and cell (an inner product follows from a distance and two
norms).  A task loads a block's data and streams its queries past, scoring by
matrix products in which whole numbers stay exact, and keeps each query's k
best; the k best over all blocks follow from partial results.

How many blocks a query is spared depends on the data alone: clustered vectors
are searched in few, while in evenly spread vectors of many dimensions all
cells lie about equally far and nearly every row is scored (:func:`share`).

Defined cases: vectors that are null, or hold null or non-finite components,
take no part.  Vectors of different lengths never meet; an empty vector scores
0 against empty ones.  Rows of equal vec_id: as queries they are one (the
smallest vector), as candidates each row counts, and rows that share the
query's id count as its own.  Null ids take no part; ids are whole numbers.
Ties go to the smaller vec_id.  A table of fewer than k + 1 vectors gives all
there are.  A component beyond the bigint range is held at its end, and so is
a score.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, shuffle_partitions, table, written

SCALE = 256


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part; v holds whole numbers as bigint."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64), np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)


def _by_dim(column: pa.Array):
    """(dimension, row numbers, matrix) for each dimension of a list column."""
    flat, n = _matrix(column)
    ends = np.cumsum(n)
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)
        yield int(d), rows, flat[at] if d else np.zeros((len(rows), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exactly, as int64."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def _cells(pivots: dict[int, np.ndarray]):
    """(id, v) -> (id, v, dim, cell, distance from the pivot, norm)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            cell, far, norm, dim = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for d, rows, m in _by_dim(batch.column(1)):
                dim[rows] = d
                norm[rows] = np.sqrt((m.astype(float) ** 2).sum(1))
                if (p := pivots.get(d)) is None or not d:
                    far[rows] = norm[rows]
                    continue
                gap = np.maximum(0, norm[rows][:, None] ** 2 - 2 * (m.astype(float) @ p.T) + (p**2).sum(1)[None, :])
                cell[rows] = gap.argmin(1)
                far[rows] = np.sqrt(((m - p[cell[rows]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (dim, cell, far, norm))], names=["id", "v", "dim", "cell", "far", "norm"])

    return run


_EPS = 1e-6  # relative slack of floating-point bounds


class Plan:
    """Where cells lie, and which blocks a query needs.

    ``summary`` rows: dim, cell, rows, least and largest distance from the
    pivot, largest norm.
    """

    def __init__(self, summary: list[tuple], pivots: dict[int, np.ndarray], block_rows: int):
        self.blocks: dict[tuple[int, int], tuple[int, int]] = {}
        number, room = 0, 0
        for dim, cell, rows, *_ in sorted(summary):
            if rows > room and room < block_rows:
                number, room = number + 1, block_rows
            pieces = max(1, -(-rows // block_rows))
            self.blocks[dim, cell] = (number, pieces)
            number, room = (number, room - rows) if pieces == 1 else (number + pieces, block_rows)
        self.by_dim = {}
        for dim in {s[0] for s in summary}:
            own = sorted(s for s in summary if s[0] == dim)
            p = pivots[dim][[s[1] for s in own]] if dim in pivots and dim else np.zeros((len(own), dim))
            between = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] - 2 * p @ p.T + (p**2).sum(1)[None, :]))
            self.by_dim[dim] = (np.array([s[1] for s in own]), p, between, *(np.array([s[i] for s in own], float) for i in (2, 3, 4, 5)))

    def home(self, dim: int, cell: int) -> int | None:
        """The block of a query's own cell, or of any cell of its length."""
        if dim not in self.by_dim:
            return None
        return self.blocks.get((dim, cell), self.blocks[dim, int(self.by_dim[dim][0][0])])[0]

    def bounds(self, dim: int, q: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Upper bounds on the inner product of each query with anything in each cell."""
        cells, p, between, _, near, far, norm = self.by_dim[dim]
        q = q.astype(float)
        square, length = (q**2).sum(1)[:, None], np.sqrt((q**2).sum(1))[:, None]
        inner = q @ p.T
        gap = np.sqrt(np.maximum(0, square - 2 * inner + (p**2).sum(1)[None, :]))
        apart = np.maximum(gap - far, near - gap)
        mine = np.searchsorted(cells, cell).clip(0, len(cells) - 1)
        known = cells[mine] == cell
        own = np.where(known, gap[np.arange(len(q)), mine], np.inf)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (gap**2 - own**2) / (2 * between[mine])
        apart = np.maximum(apart, np.where(np.isfinite(plane), plane, 0))
        by_distance = (square + norm[None, :] ** 2 - np.maximum(0, apart - _EPS * (gap + far + 1)) ** 2) / 2
        return np.minimum(inner + length * far, by_distance) + _EPS * (np.abs(inner) + length * (far + norm) + 1)

    def visits(self, dim: int, q: np.ndarray, cell: np.ndarray, floor: np.ndarray) -> list[list[int]]:
        """Blocks that each query needs besides its home; ``floor`` is its k-th best score there."""
        if dim not in self.by_dim:
            return [[] for _ in q]
        cells = self.by_dim[dim][0].tolist()
        lists = [range((b := self.blocks[dim, c])[0], b[0] + b[1]) for c in cells]
        out = []
        for row, c in zip(self.bounds(dim, q, cell) >= floor[:, None], cell.tolist(), strict=True):
            out.append(sorted({b for j in np.flatnonzero(row) for b in lists[j]} - {self.home(dim, c)}))
        return out


def _solve(k: int):
    """(block, query, id, v) sorted by block with data first -> each query's k best in the block."""

    def run(batches):
        now, ids, data = None, {}, {}
        ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            block = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            query = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            key = block * 2 + query
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, ids, data, ready = block[a], {}, {}, {}
                part = batch.slice(a, b - a)
                own = np.asarray(part.column(2).to_numpy(zero_copy_only=False))
                for d, rows, m in _by_dim(part.column(3)):
                    if not query[a]:
                        ids.setdefault(d, []).append(own[rows])
                        data.setdefault(d, []).append(m)
                        continue
                    if d not in data:
                        continue
                    if d not in ready:
                        i, x = np.concatenate(ids[d]), np.concatenate(data[d])
                        order = np.argsort(i, kind="stable")
                        ready[d] = i[order], x[order]
                    i, x = ready[d]
                    step = max(1, (1 << 23) // max(1, len(i)))
                    for at in range(0, len(rows), step):
                        got = _best(own[rows[at : at + step]], products(m[at : at + step], x), i, k)
                        if len(got[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

    return run


def _best(queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """The k best of each row of scores, candidates sorted by id; the query's own id is out."""
    out_q, out_i, out_s = [], [], []
    lowest = np.iinfo(np.int64).min
    for q, row in zip(queries, scores, strict=True):
        a, b = np.searchsorted(ids, q), np.searchsorted(ids, q, "right")
        row[a:b] = lowest
        n = len(ids) - (b - a)
        if n <= 0:
            continue
        kth = np.partition(row, -min(k, n))[-min(k, n)]
        found = np.flatnonzero(row >= kth)
        found = found[(found < a) | (found >= b)]
        best = found[np.lexsort((ids[found], -row[found]))][:k]
        out_q.append(np.full(len(best), q))
        out_i.append(ids[best])
        out_s.append(row[best])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return join(out_q), join(out_i), join(out_s)


_CELLS = "id bigint, v array<bigint>, dim bigint, cell bigint, far double, norm double"


def _prepared(queries: DataFrame, data: DataFrame, n_pivots: int | None, block_rows: int | None, most_pivots: int):
    """(placed data, placed queries, plan): tables are written, pivots and summary come to the driver."""
    spark = data.sparkSession
    shared_dir(spark)
    total = data.count()
    n = n_pivots or int(min(most_pivots, max(16, total**0.5)))
    rows = block_rows or int(min(131_072, max(4096, total / (2 * shuffle_partitions(spark)))))
    pivots: dict[int, list] = {}
    for r in data.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(n).collect():
        pivots.setdefault(len(r.v), []).append(r.v)
    centres = {d: np.unique(np.array(v, float), axis=0) for d, v in pivots.items() if d}
    placed = written(data.mapInArrow(_cells(centres), _CELLS), "knn-data")
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    asked = written(one.mapInArrow(_cells(centres), _CELLS), "knn-queries")
    per = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.min("far").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm"))
    summary = [(r.dim, r.cell, r.rows, r.near, r.far, r.norm) for r in per.collect()]
    return placed, asked, Plan(summary, centres, rows)


def _solved(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(block, id, v) data and queries -> each query's k best of each block it is sent to."""
    both = rows.select("block", F.lit(0).alias("query"), "id", "v").unionByName(asks.select("block", F.lit(1).alias("query"), "id", "v"))
    dealt = both.repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block", "query")
    return dealt.mapInArrow(_solve(k), "query_id bigint, vec_id bigint, score bigint")


def _sent(plan: Plan):
    """(id, v, dim, cell, floor) -> (id, v, visit): a query without a floor goes home, others where they are needed."""

    def run(batches):
        for batch in batches:
            visit: list[list[int]] = [[] for _ in range(batch.num_rows)]
            cell = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), np.int64)
            floor = np.asarray(batch.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False), float)
            first = batch.column(5).to_numpy(zero_copy_only=False)
            for d, rows, m in _by_dim(batch.column(1)):
                if len(rows) and first[rows[0]]:
                    found = [[] if (b := plan.home(d, c)) is None else [b] for c in cell[rows].tolist()]
                else:
                    found = [x for at in range(0, len(rows), 512) for x in plan.visits(d, m[at : at + 512], cell[rows[at : at + 512]], floor[rows[at : at + 512]])]
                for i, x in zip(rows, found, strict=True):
                    visit[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(visit, pa.list_(pa.int64()))], names=["id", "v", "visit"])

    return run


_VISITS = "id bigint, v array<bigint>, visit array<bigint>"


def _searched(placed: DataFrame, asked: DataFrame, plan: Plan, k: int) -> tuple[DataFrame, DataFrame]:
    """(partial results of all blocks, queries with the blocks they visit after their home)."""
    spark = placed.sparkSession
    cells = [(d, c, first, pieces) for (d, c), (first, pieces) in plan.blocks.items()]
    block_of = F.broadcast(spark.createDataFrame(cells, "dim bigint, cell bigint, first bigint, pieces bigint"))  # a row a cell
    rows = placed.join(block_of, ["dim", "cell"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).alias("block"), "id", "v")
    nothing = F.lit(None).cast("double")
    home = asked.select("id", "v", "dim", "cell", nothing.alias("floor"), F.lit(True).alias("first")).mapInArrow(_sent(plan), _VISITS)
    near = written(_solved(rows, home.select("id", "v", F.explode("visit").alias("block")), k), "knn-near")
    floors = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    known = asked.join(floors, asked["id"] == floors["query_id"], "left").select("id", "v", "dim", "cell", "floor", F.lit(False).alias("first"))
    more = written(known.mapInArrow(_sent(plan), _VISITS), "knn-visits")
    return near.unionByName(_solved(rows, more.select("id", "v", F.explode("visit").alias("block")), k)), more


def knn_join(queries: DataFrame, data: DataFrame, k: int = 5, n_pivots: int | None = None, block_rows: int | None = None, most_pivots: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, v) tables as :func:`quantized` gives them.

    ``most_pivots`` bounds the rows that come to the driver: pivots and summary.
    """
    found, _ = _searched(*_prepared(queries, data, n_pivots, block_rows, most_pivots), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share(queries: DataFrame, data: DataFrame, k: int = 5, n_pivots: int | None = None, block_rows: int | None = None, most_pivots: int = 1024) -> float:
    """The share of (query, row) pairs that the join scores."""
    placed, asked, plan = _prepared(queries, data, n_pivots, block_rows, most_pivots)
    _, more = _searched(placed, asked, plan, k)
    size: dict[int, float] = {}
    for (d, c), (first, pieces) in plan.blocks.items():
        cells, rows = plan.by_dim[d][0], plan.by_dim[d][3]
        for b in range(first, first + pieces):
            size[b] = size.get(b, 0) + rows[np.searchsorted(cells, c)] / pieces
    sizes = F.broadcast(data.sparkSession.createDataFrame([(b, float(n)) for b, n in size.items()], "block bigint, rows double"))
    scored = more.select(F.explode("visit").alias("block")).join(sizes, "block").agg(F.coalesce(F.sum("rows"), F.lit(0.0))).first()[0]
    homes = sum(n * size[plan.home(d, c)] for d, c, n in asked.groupBy("dim", "cell").count().collect() if plan.home(d, c) is not None)
    return float((scored + homes) / (asked.count() * placed.count()))


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = quantized(table(spark, sf_dir, "embeddings"))
    return knn_join(data.where("id % 50 = 0"), data)


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id),
p AS (SELECT query_id, e.vec_id,
             CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * e.v[i])), 0) AS BIGINT) AS score
      FROM q JOIN e ON e.vec_id <> q.query_id AND len(e.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
