"""Operators for preparing training data: one module each, and their ready-to-run queries.

Functions of this package that run in Python workers travel with the plan that uses them, so a
cluster need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
