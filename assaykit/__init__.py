"""Sample-table analytics on Spark: composable DataFrame operators and fitted models."""

import sys

from pyspark import cloudpickle

# functions of this package travel inside the task, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from assaykit.table import TableSpec, hash_uniform, row_key  # noqa: E402

__all__ = ["TableSpec", "hash_uniform", "row_key"]
