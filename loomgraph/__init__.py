"""Property-graph analytics on Spark DataFrames.

A graph is a schema plus one DataFrame per node set and per edge set.  Every
operator builds a lazy plan; nothing is collected except metadata whose size is
bounded by a parameter.

Functions that run on executors are sent with their code, so this package has to be
installed where the driver runs only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
