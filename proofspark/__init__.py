"""Proofreading analytics over large document collections, as DataFrame-to-DataFrame functions."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
