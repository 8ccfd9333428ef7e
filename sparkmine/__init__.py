"""sparkmine: pattern and graph mining as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Python workers get this code with the task, so that it needn't be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
