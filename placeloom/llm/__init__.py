"""Operators for training-data pipelines.

Functions sent to executors are pickled by value, so executors need this
package's dependencies (numpy, pyarrow, ...) but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
