"""Operators for large text corpora. Task code of this package travels with the job: executors need no install of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
