"""tidesift: curation of labeled short texts and cascade evaluation on Spark.

Every operator takes and returns DataFrames (or Columns) and leaves physical
planning to Catalyst and AQE.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
