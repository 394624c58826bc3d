"""Retail listing comparison on Spark DataFrames.

Column rules live in ``functions``, table-to-table operators in ``operators``,
readers and writers in ``sources``, multi-step jobs in ``plans``, the streaming
job in ``streaming`` and the driver-facing query suite in ``suite``.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
