"""Matching of text profiles and postings on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan, so that the package has to be
# installed where the driver runs only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
