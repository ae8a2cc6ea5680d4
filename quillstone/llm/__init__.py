"""Training-data operators: each module is one operator, ``queries`` registers them."""

from pyspark import cloudpickle

import quillstone.llm as _package

# Functions of this package travel to the executors by value, so they need no copy of it there.
cloudpickle.register_pickle_by_value(_package)
