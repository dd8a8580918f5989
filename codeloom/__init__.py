"""Code-corpus and suggestion analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
