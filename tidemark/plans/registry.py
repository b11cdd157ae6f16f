"""Where every query on the given tables is registered with its DuckDB twin."""

from ..sources.tables import Tables

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register fn(tables) -> DataFrame under `name`; `sql` is the oracle text."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap
