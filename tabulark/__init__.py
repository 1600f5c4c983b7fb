"""Machine-learning experiments on tables of any size, as Spark jobs.

Every operator takes DataFrames and returns DataFrames. Only fitted parameters,
metrics and lookups under a checked bound ever reach the driver.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
