"""Ontology-aware vector, graph and trace analytics as Spark programs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
