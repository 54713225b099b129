"""Numeric and vector column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratemill.schema import CLASS_VALUES, INVERTED_METRIC

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used.
    Inside a lambda a plain column expression would run again for every element."""
    return F.transform(F.array(value), body)[0]


def no_nan(value: ColumnLike) -> Column:
    """NaN counts as missing."""
    return F.nanvl(as_column(value).cast("double"), F.lit(None).cast("double"))


def to_numeric(value: ColumnLike) -> Column:
    """Number, or null where the text is not one."""
    return as_column(value).try_cast("double")


def uniform(*parts) -> Column:
    """Reproducible number in (0, 1), a pure function of its parts.

    The same rows give the same draws on any cluster, in any order and after any
    retry. 32 bits collide beyond some 65,000 rows, so orderings by this number
    must add an id as tie-break.
    """
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def clip01(value: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_column(value)))


def flip_metric(metric: ColumnLike, value: ColumnLike) -> Column:
    """``1 - value`` for the one metric whose scale runs the other way."""
    metric, value = as_column(metric), as_column(value)
    return F.when(metric == INVERTED_METRIC, 1.0 - value).otherwise(value)


def metric_bin(value: ColumnLike) -> Column:
    value = as_column(value)
    return F.when(value <= 0.0, "low").when(value >= 1.0, "high").when(value.isNotNull(), "mid")


def label_class(value: ColumnLike, missing_class: int = 0) -> Column:
    """Class 0, 1 or 2 of a rating; text that is no number is class 0.

    ``missing_class`` says where a missing (null or NaN) rating goes.
    """
    raw = as_column(value)
    number = to_numeric(raw)
    missing = raw.isNull() | F.coalesce(F.isnan(number), F.lit(False))
    return (
        F.when(missing, F.lit(missing_class))
        .when(number.isNull() | (number < 0.25), F.lit(0))
        .when(number < 0.75, F.lit(1))
        .otherwise(F.lit(2))
    )


def expected_value(logits: ColumnLike, values: Sequence[float] = tuple(CLASS_VALUES)) -> Column:
    """Softmax-weighted mean of the class values."""
    table = F.array(*[F.lit(float(v)) for v in values])

    def add(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)

    def mean(weights: Column) -> Column:
        return F.try_divide(add(F.zip_with(weights, table, lambda w, v: w * v)), add(weights))

    def softmax(pair: Column) -> Column:
        return F.transform(pair["z"], lambda x: F.exp(x - pair["top"]))

    z = as_column(logits)
    return let(let(z, lambda v: let(F.struct(v.alias("z"), F.array_max(v).alias("top")), softmax)), mean)


def argmax_value(logits: ColumnLike, values: Sequence[float] = tuple(CLASS_VALUES)) -> Column:
    """Value of the most likely class, the first one on ties."""
    logits = as_column(logits)
    table = F.array(*[F.lit(float(v)) for v in values])
    return F.try_element_at(table, F.array_position(logits, F.array_max(logits)).cast("int"))


def dot(left: ColumnLike, right: ColumnLike) -> Column:
    products = F.zip_with(
        as_column(left), as_column(right), lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: ColumnLike) -> Column:
    """Unit vector; a zero vector stays zero."""

    def scale(v: Column) -> Column:
        norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
        return let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return let(as_column(vector), scale)


def mean_pool(vectors: ColumnLike, mask: ColumnLike) -> Column:
    """Mean of those token vectors whose mask is not 0, weighted by the mask."""
    vectors, mask = as_column(vectors), as_column(mask)
    size = F.size(F.try_element_at(vectors, F.lit(1)))
    weighted = F.zip_with(
        vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double"))
    )
    total = F.aggregate(
        weighted,
        F.array_repeat(F.lit(0.0), size),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(1e-9))
    return let(weight, lambda w: F.transform(total, lambda x: x / w))


def format_value(value: ColumnLike) -> Column:
    return F.format_string("%.3f", as_column(value).cast("double"))
