"""Security-event analytics on PySpark: flows, Windows events, scoring, alerts, search and detectors."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
