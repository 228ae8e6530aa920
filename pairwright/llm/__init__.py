"""Operators for preparing training corpora. Nothing else in the library imports this package.

Functions that run on executors are pickled by value, so that the workers need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
