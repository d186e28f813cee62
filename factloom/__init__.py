"""Document-to-facts analytics on Spark: every operator maps DataFrames to DataFrames or Columns to Columns."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
