"""Spark-native analytics for financial-transaction risk.

The package works on one transactions table.  Every operator takes and returns
DataFrames; what an operator learns from the data (type statistics, scaler
parameters, sampling cut-offs) is a handful of scalars, so applying it later is
a narrow projection or filter over the table.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

# Functions that run on executors travel with the task, so the package need not
# be installed there.
_by_value(_sys.modules[__name__])
