"""Similarity search, fingerprints and sortable vector IDs on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so the package needs no
# installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
