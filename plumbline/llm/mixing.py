"""Mixing sources to target weights.

Every document gets a hash-random key.  The key space is cut into equal
ranges, as many for a source as its rows need; since keys are hashes, the
ranges of one source hold about equally many rows.  (source, range) is thus a
range sort whose bounds no sampling can move between two jobs.  Word counts
are summed per range before anything is shuffled, a running sum over the
ranges of a source gives each its offset, and the one range of a source that
holds its budget's end is sorted to find the document on the edge.  Documents
before the edge are taken once more than the source's whole epochs, those
after it are not, the one on it is taken in part, to the exact word.

The edge is one small row a source, so applying the mix never shuffles texts.
Everything is DataFrame code; no source, however large, meets in one task.

Defined cases: null or empty texts have size 0 and take 0 words; in the
emitted mix they ride along when they sort before the edge.  A null source is
a source of its own, last.  A null id is hashed like any value.  Repeated rows
(equal id, source and size) are taken alike.  An empty table gives an empty
mix.  Ids may be of any type.  Extra columns stay out of the query and pass
through the stage whatever their names.

Of the sources themselves one row each is held in one task to share out the
targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ASCII_WS, Held, table, written

#: Share weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words, in percent.
TOTAL_PERCENT = 150
#: No source is taken more often than this.
MAX_EPOCHS = 2


def word_count(text: str) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{ASCII_WS}]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets per source of a (s_null, s, source_size) table, one row a source.

    Water filling: with sources in order of size per weight, a source is held
    at its ceiling if the level that the others would get exceeds it.  All
    sums stay whole numbers, and one division makes the target.
    """
    by_name = Window.orderBy("s_null", "s")
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), "s_null", "s")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("bigint"))
    t = t.withColumn("held_sizes", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    t = t.withColumn("w_rest", F.sum("w").over(rest))
    t = t.withColumn("left100", F.sum("source_size").over(everything) * TOTAL_PERCENT - F.col("held_sizes") * (100 * MAX_EPOCHS))
    ceiling = F.col("source_size").cast("decimal(20,0)") * (F.col("w_rest") * (100 * MAX_EPOCHS)).cast("decimal(17,0)")
    t = t.withColumn("held", F.col("w") * F.col("left100") >= ceiling)
    # of the sources that aren't held, the first in level order has the most weight from it on
    t = t.withColumn("level", F.max(F.when(~F.col("held"), F.struct("w_rest", "left100"))).over(everything))
    full = (F.col("source_size") * MAX_EPOCHS).cast("double")
    share = (F.col("w") * F.col("level.left100")).cast("double") / (F.col("level.w_rest") * 100).cast("double")
    return t.select("s_null", "s", "source_size", F.when(F.col("held"), full).otherwise(share).alias("target"))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``docs`` with the columns that place a row in the mix, under ``__mix``."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.withColumn(
        "__mix",
        F.struct(
            F.col(source_col).isNull().alias("s_null"),
            F.coalesce(F.col(source_col), F.lit("")).alias("s"),
            key.alias("key"),
            F.col(id_col).alias("id"),
            word_count(text_col).alias("size"),
        ),
    )


def plan_mix(base: DataFrame, rows_per_range: int = 4_000) -> DataFrame:
    """Of a (s_null, s, key, id, size, m) table: per source its size, target, whole epochs, edge row and the edge's words.

    ``m`` is the number of repeated rows; ``rows_per_range`` bounds what is
    sorted together.
    """
    per = base.groupBy("s_null", "s").agg(F.sum(F.col("size") * F.col("m")).cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(per.select("s_null", "s", "source_size"))
    sources = per.select(F.col("s_null"), F.col("s"), F.ceil(F.col("n") / rows_per_range).alias("ranges"))
    sources = sources.join(targets, ["s_null", "s"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    sources = sources.withColumn("epochs", epochs)
    sources = written(sources.withColumn("rest", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size")), "mix-sources")

    high = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), 1)
    ranged = base.join(sources, ["s_null", "s"]).withColumn("range", F.shiftright(high * F.col("ranges"), 31))
    parts = ranged.groupBy("s_null", "s", "range", "rest").agg(F.sum(F.col("size") * F.col("m")).alias("part"))
    # running sums in two levels, so a source of any size has short windows: over blocks of 1024 ranges, and inside each
    parts = parts.withColumn("block", F.shiftright("range", 10))
    blocks = parts.groupBy("s_null", "s", "block").agg(F.sum("part").alias("whole"))
    ahead = F.sum("whole").over(Window.partitionBy("s_null", "s").orderBy("block")) - F.col("whole")
    inner = F.sum("part").over(Window.partitionBy("s_null", "s", "block").orderBy("range")) - F.col("part")
    parts = parts.withColumn("inner", inner).join(blocks.select("s_null", "s", "block", ahead.alias("ahead")), ["s_null", "s", "block"]).withColumn("offset", F.col("ahead") + F.col("inner"))
    # the budget's end lies in one range of a source
    cut = parts.where((F.col("offset") < F.col("rest")) & (F.col("rest") <= F.col("offset") + F.col("part"))).select("s_null", "s", "range", "offset")
    cut = written(cut, "mix-cuts")  # one row a source: its size is known when the join below is planned
    inside = ranged.join(cut, ["s_null", "s", "range"])
    place = Window.partitionBy("s_null", "s", "range").orderBy("key", "id", "size")
    own = F.col("size") * F.col("m")
    inside = inside.withColumn("before", F.col("offset") + F.sum(own).over(place) - own).where(F.col("before") < F.col("rest"))
    last = inside.groupBy("s_null", "s").agg(F.max(F.struct("key", "id", "size", F.floor(F.least(own, F.col("rest") - F.col("before")) / F.col("m")).alias("words"))).alias("edge"))
    out = sources.join(last, ["s_null", "s"], "left")
    edge = F.when(F.col("edge").isNotNull(), F.struct("edge.key", "edge.id", "edge.size"))
    return written(out.select("s_null", "s", "source_size", "target", "epochs", edge.alias("edge"), F.col("edge.words").alias("edge_words")), "mix-edges")


def apply_mix(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with a ``__mix`` column -> with ``__source_size``, ``__target``, ``__taken`` and ``__copies``."""
    e = edges.select(*[F.col(c).alias(f"__e_{c}") for c in edges.columns])
    at = F.struct("__mix.key", "__mix.id", "__mix.size")
    joined = rows.join(e, (F.col("__mix.s_null") == F.col("__e_s_null")) & (F.col("__mix.s") == F.col("__e_s")))
    before, on = F.coalesce(at < F.col("__e_edge"), F.lit(False)), F.coalesce(at == F.col("__e_edge"), F.lit(False))
    most = on & (2 * F.col("__e_edge_words") >= F.col("__mix.size"))
    more = F.when(before, F.col("__mix.size")).when(on, F.col("__e_edge_words")).otherwise(F.lit(0))
    return joined.select(
        *rows.columns,
        F.col("__e_source_size").alias("__source_size"),
        F.col("__e_target").alias("__target"),
        (F.col("__e_epochs") * F.col("__mix.size") + more).cast("bigint").alias("__taken"),
        (F.col("__e_epochs") + (before | F.coalesce(most, F.lit(False))).cast("bigint")).cast("int").alias("__copies"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", rows_per_range: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """(placed rows with their number ``m`` of repeats, edges per source), both in written tables."""
    base = keyed(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, seed).select("__mix.*")
    base = written(base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("m")), "mix-rows")
    return base, plan_mix(base, rows_per_range)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, edges = mixture(table(spark, sf_dir, "documents"))
    rows = base.select(F.struct("s_null", "s", "key", "id", "size").alias("__mix"), F.explode(F.expr("sequence(1, m)")).alias("__n"))
    out = apply_mix(rows, edges)
    return out.select(F.col("__mix.id").alias("doc_id"), F.col("__mix.size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; the one on a source's edge whole if the mix takes half of it."""
    _, edges = mixture(docs)
    held = Held(docs)
    placed = apply_mix(keyed(held.df, held["doc_id"], held["text"], held["source"], "mix"), edges)
    copies = F.explode(F.expr("if(__copies > 0, sequence(1, __copies), array())"))
    return held.back(placed.where(F.col("__copies") > 0).withColumn("__copy", copies))


#: Sources, targets and the mix of a table ``{docs}`` with doc_id, text and source.
MIX_SQL = """
d AS (SELECT doc_id, text, source, source IS NULL AS s_null, coalesce(source, '') AS s,
             CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM {docs}),
s0 AS (SELECT s_null, s, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY ALL),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY s_null, s) - 1) % 3 + 1] AS BIGINT) AS w FROM s0),
s2 AS (SELECT *, coalesce(sum(ss) OVER (ORDER BY ss / w, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_sizes,
              sum(w) OVER (ORDER BY ss / w, s_null, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest, sum(ss) OVER () AS n FROM s1),
s3 AS (SELECT *, n * 150 - held_sizes * 200 AS left100, w * (n * 150 - held_sizes * 200) >= ss * 200 * w_rest AS held FROM s2),
s4 AS (SELECT *, max(CASE WHEN NOT held THEN w_rest END) OVER () AS lw FROM s3),
s5 AS (SELECT *, max(CASE WHEN NOT held AND w_rest = lw THEN left100 END) OVER () AS ll FROM s4),
s6 AS (SELECT s_null, s, ss, CASE WHEN held THEN CAST(2 * ss AS DOUBLE) ELSE CAST(w * ll AS DOUBLE) / CAST(lw * 100 AS DOUBLE) END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(round(target) / ss) AS BIGINT) ELSE 0 END AS epochs FROM s6),
s8 AS (SELECT *, CAST(round(target) AS BIGINT) - epochs * ss AS rest FROM s7),
mixed AS (SELECT d.*, ss, target, epochs, rest,
             CAST(sum(size) OVER (PARTITION BY d.s_null, d.s ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
      FROM d JOIN s8 ON d.s_null = s8.s_null AND d.s = s8.s)"""

OP3_SQL = f"""WITH {MIX_SQL.format(docs="documents")}
SELECT doc_id, size, ss AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM mixed"""
