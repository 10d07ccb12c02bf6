"""Operators for preparing training text at scale.  Nothing else in the library imports this package."""

from pyspark import cloudpickle

import drawlog

# Executors need not have the package installed: send its functions with the task.
cloudpickle.register_pickle_by_value(drawlog)
