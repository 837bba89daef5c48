"""Space-time event analytics on Spark DataFrames.

Events are observed on a regular scene clock and a regular lon/lat grid; every
operator is a function ``DataFrame -> DataFrame`` that can be used through
``DataFrame.transform``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
