"""Marginalia: a PySpark-native engine for document knowledge bases."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors carry their code along, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
