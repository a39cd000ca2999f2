"""Evidence retrieval and retrieval evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from .config import RetrievalOptions, SearchFilters, parse_request
from .errors import RetrievalError

__all__ = ["RetrievalOptions", "SearchFilters", "parse_request", "RetrievalError"]
__version__ = "0.1.0"

# Task functions travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
