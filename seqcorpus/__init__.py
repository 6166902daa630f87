"""seqcorpus: parallel-corpus preparation and sequence evaluation as Spark DataFrame operators.

Every public function takes DataFrames (and plain parameters) and returns a DataFrame.
No function keeps a global session; the session is always taken from the input frame.
"""

from seqcorpus.constants import BOS_LUA, PAD, EOS, UNK, NSPECIAL, SPECIAL_SYMBOLS  # noqa: F401

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this package that run in Python workers are sent by value: executors need no copy of it
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
