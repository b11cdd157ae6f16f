"""Small column builders used by several operators."""

import math

from pyspark.sql import functions as F

LOG_2PI = math.log(2 * math.pi)


def log_density(y, mean, var):
    """Gaussian log predictive density."""
    return -0.5 * (F.lit(LOG_2PI) + F.log(var) + (y - mean) ** 2 / var)


def relative_se(se, value, log_scaled):
    """SE itself on the log scale, SE/|value| otherwise, NULL at value 0."""
    return F.when(log_scaled, se).otherwise(F.try_divide(se, F.nullif(F.abs(value), F.lit(0.0))))


def let(value, body):
    """Bind a value once per row for use inside lambdas: body(value).

    An expression named inside a lambda is evaluated again for every element; bound as
    the element of a one-element array it is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def dot(x, y):
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def total(x):
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def vec_norm(x):
    return F.sqrt(dot(x, x))


def cosine(x, y):
    return F.try_divide(dot(x, y), vec_norm(x) * vec_norm(y))


def bit_entropy(p):
    """Entropy of a binary source, 0 at p = 0 or 1."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def pearson(x, y):
    """Correlation aggregate that gives NULL, not an error, when a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), sx * sy)
