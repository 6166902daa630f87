"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage.

Task functions are pickled by value, so executors need no copy of this package on their disks.
"""

from pyspark import cloudpickle

import seqcorpus

cloudpickle.register_pickle_by_value(seqcorpus)
