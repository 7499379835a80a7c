"""Clinical data flows, cohort analytics and risk scoring as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
