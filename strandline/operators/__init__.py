"""Operators over ordered frames and evidence ledgers: DataFrames in, DataFrames out."""



import sys

from pyspark import cloudpickle

# workers need not have this package: its functions travel with the tasks that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
