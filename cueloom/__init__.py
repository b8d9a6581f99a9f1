"""cueloom: timed-text and media-job analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers as code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
