"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Functions that run in Python workers are shipped by
value, so executors need PySpark and the listed libraries, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["freqloom"])
