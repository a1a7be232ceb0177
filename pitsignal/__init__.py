"""Heavy-equipment telemetry analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from pitsignal.session import configure, land, scratch_dir

# Functions that run inside tasks travel with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "land", "scratch_dir"]
