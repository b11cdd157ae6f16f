"""Joins with a tolerance, a fixed precedence or an expected list."""

from functools import reduce

from pyspark.sql import functions as F


def tolerance_join(left, right, equal, near, order, first_only=True):
    """Equality on `equal`, |difference| < tol for every column of near {col: tol}.

    The first near column is cut into cells of its tolerance and joined by equality
    (each left row probes three cells); the rest is checked on the candidates.  The
    right side's near columns come back as `<col>_r`.  Equal left rows are matched once
    and come back as often as they were.
    """
    cell_on, tol = next(iter(near.items()))
    cell = lambda c: F.floor(c / tol).cast("long")
    r = right.withColumnsRenamed({c: f"{c}_r" for c in near}).withColumn("_cell", cell(F.col(f"{cell_on}_r")))
    once = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_copies"))
    l = once.withColumn("_row", F.struct(*left.columns)).withColumn("_cell", F.explode(F.array(*[cell(F.col(cell_on)) + d for d in (-1, 0, 1)])))
    ok = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"{c}_r")) < v for c, v in near.items()])
    d = l.join(r, list(equal) + ["_cell"]).where(ok)
    if first_only:
        extra = [c for c in r.columns if c not in list(equal) + ["_cell"]]
        best = d.groupBy("_row", "_copies").agg(F.min_by(F.struct(*extra), F.struct(*order)).alias("_m"))
        return best.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*", "_m.*")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_cell", "_row", "_copies", "_copy")


def paired(rows, unit, cond, value, a, b):
    """(unit, a, b, diff) of units that have both conditions, non-null."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    p = rows.where(F.col(cond).isin(a, b) & ok).groupBy(unit).agg(
        F.avg(F.when(F.col(cond) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(cond) == b, F.col(value))).alias("b"))
    return p.where("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))
