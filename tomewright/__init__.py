"""Spark jobs that turn a corpus of files into a searchable knowledge base."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need not have this
# package installed, wherever the driver was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
