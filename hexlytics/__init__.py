"""Incident analytics on Spark: layered tables, hex-cell aggregates, hotspot queries, tests."""

from pyspark import cloudpickle

from hexlytics.functions import distributions
from hexlytics.operators import closedtest

# Helpers that run inside Python workers travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(distributions)
cloudpickle.register_pickle_by_value(closedtest)
