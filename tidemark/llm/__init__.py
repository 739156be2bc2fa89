"""Operators that prepare a text corpus for language-model training."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so no copy of this package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
