"""Mixed-model association analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
