"""Operators for building language-model training corpora.

Every operator takes and returns DataFrames.  Code that runs on executors is
pickled by value, so that a cluster needs no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
