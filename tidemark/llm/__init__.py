"""Operations of a training-data pipeline: scoring, filtering, deduplication and packing of text.

Each operator is a module of its own with a general interface; ``queries`` holds the thin
registered queries. Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with the jobs: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
