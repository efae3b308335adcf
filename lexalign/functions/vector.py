"""Column expressions over ``array<double>`` vectors.

Everything here is a built-in higher-order function (``transform``,
``zip_with``, ``aggregate``), so it runs in the JVM and never crosses into
Python.  Accumulation is always in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: ColumnOrName) -> Column:
    return _c(v).cast("array<double>")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda s, x: s + x)


def sq_norm(v: ColumnOrName) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda s, x: s + x * x)


def norm(v: ColumnOrName) -> Column:
    return F.sqrt(sq_norm(v))


def vsum(v: ColumnOrName) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda s, x: s + x)


def vmean(v: ColumnOrName) -> Column:
    return vsum(v) / F.size(_c(v))


def _per_row(v: ColumnOrName, c: ColumnOrName) -> Column:
    """A per-row scalar repeated to the vector length.

    A scalar referenced inside a lambda body is evaluated once per *element*;
    passing it as an argument array evaluates it once per row.
    """
    return F.array_repeat(_c(c), F.size(_c(v)))


def scale(v: ColumnOrName, c: ColumnOrName | float) -> Column:
    if not isinstance(c, (Column, str)):
        cc = F.lit(float(c))
        return F.transform(_c(v), lambda x: x * cc)
    return F.zip_with(_c(v), _per_row(v, c), lambda x, y: x * y)


def divide(v: ColumnOrName, c: ColumnOrName) -> Column:
    return F.zip_with(_c(v), _per_row(v, c), lambda x, y: x / y)


def shift(v: ColumnOrName, c: ColumnOrName) -> Column:
    return F.zip_with(_c(v), _per_row(v, c), lambda x, y: x - y)


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def mul(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def div_elementwise(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x / y)



def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a·b / sqrt(a·a * b·b)`` as in the reference similarity scorer."""
    return F.try_divide(dot(a, b), F.sqrt(sq_norm(a) * sq_norm(b)))


def unit(v: ColumnOrName) -> Column:
    """``v / ||v||`` with a zero norm replaced by 1."""
    n = norm(v)
    return divide(v, F.when(n == 0, F.lit(1.0)).otherwise(n))
