"""Registra: analytics over public-procurement contract registers, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
