"""Tidemark: Spark jobs for event-annotated recordings and the studies built on them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that a worker needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
