"""recollect: analytics over long-lived text memories, graphs, events and vectors, on Spark."""
from pyspark import cloudpickle

import recollect as _self

# Python workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(_self)
