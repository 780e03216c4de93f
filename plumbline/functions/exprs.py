"""Scalar building blocks: coercion, ratios, shapes, paths.

The coercion rules live here once.  A number is what a strict numeric text
says; NaN and anything unreadable is missing, that is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)$"
#: Texts that stand for a missing value in CSV files.
MISSING_TEXT = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def num(c: Column | str) -> Column:
    """Text or number as double; null where it isn't a number."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def text_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.isin(*MISSING_TEXT), c)


def micros(c: Column | str) -> Column:
    """A timestamp column as whole microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def finite(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) != F.lit(float("inf")))


def symmetric_ratio(a: Column, b: Column) -> Column:
    """The larger over the smaller; 1 if either isn't positive."""
    return F.when((a <= 0) | (b <= 0), F.lit(1.0)).otherwise(F.greatest(a / b, b / a))


def drop_ratio(old: Column, new: Column) -> Column:
    """Share lost from old to new; 0 for gains and from nothing."""
    return F.when((new < old) & (old > 0), F.try_divide((old - new).cast("double"), old.cast("double"))).otherwise(F.lit(0.0))


def missing_count(gap: Column, expected: Column) -> Column:
    """Samples that a gap swallowed, one at least; halves round to even."""
    return F.greatest(F.lit(1), (F.rint(F.try_divide(gap, expected)) - 1).cast("bigint"))


def norm(v: Column) -> Column:
    """Euclidean norm of an array of numbers."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def is_vector(v: Column, n: int) -> Column:
    """An array of n finite numbers."""
    return F.coalesce((F.size(v) == n) & F.forall(v, finite), F.lit(False))


def is_matrix(m: Column, rows: int, columns: int) -> Column:
    return F.coalesce((F.size(m) == rows) & F.forall(m, lambda r: is_vector(r, columns)), F.lit(False))


def unit_norm(n: Column, rel: float = 0.01, absolute: float = 0.01) -> Column:
    return F.abs(n - 1) <= F.greatest(F.lit(rel) * F.greatest(n, F.lit(1.0)), F.lit(absolute))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))


def sensor_kind(name: Column) -> Column:
    """Kind of sensor by what its name holds."""
    low = F.lower(name)
    return F.when(low.contains("camera"), "camera").when(low.contains("lidar"), "lidar").when(low.contains("imu"), "imu").when(low.contains("gps"), "gps").otherwise("other")


def topic_kind(topic: Column, schema: Column) -> Column:
    """Kind of sensor by keywords of a topic and its message schema."""
    both = F.lower(F.concat_ws(" ", topic, schema))
    has = lambda *words: both.rlike("|".join(words))
    return F.when(has("image", "camera"), "camera").when(has("lidar", "pointcloud", "points"), "lidar").when(has("imu"), "imu").when(has("gps", "navsat", "gnss"), "gps").otherwise("topic")


def range_ids(spec: Column) -> Column:
    """Ids of an ``a:b`` range, b left out; a plain number is itself."""
    a, b = (F.trim(F.split_part(spec, F.lit(":"), F.lit(i))).try_cast("bigint") for i in (1, 2))
    span = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(spec.contains(":"), F.coalesce(span, F.array().cast("array<bigint>"))).when(a.isNotNull(), F.array(a)).otherwise(F.array().cast("array<bigint>"))
