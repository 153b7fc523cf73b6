"""Operators for large-scale training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# what runs on executors travels with the job, so that they need no installation of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
