"""Operators for training-data pipelines: dedup, decontamination, classifiers, mixing, search. Nothing outside imports this."""

import sys

from pyspark import cloudpickle

# Functions of this folder run on executors that need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
