"""Operators for large training-data pipelines (near-dedup, scoring, extraction, mixing).

Nothing outside this subpackage imports it.  Python functions that run on
executors are shipped by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
