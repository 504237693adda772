"""Operators for preparing large text corpora. Nothing else in the library imports them.

Functions that run in Python workers travel by value, so the workers need not have this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
