"""corpusloom: text-corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from corpusloom.operators import *  # noqa: F401,F403
from corpusloom.operators import __all__ as _operators
from corpusloom.sources.views import ViewStore

__all__ = [*_operators, "ViewStore"]

# Task functions travel with the job, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
