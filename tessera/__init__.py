"""Tessera: a Spark-first engine for redaction, tracking and transcript tables."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks that use them; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
