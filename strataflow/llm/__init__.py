"""Training-data operators: text scoring, deduplication, archives and mixing.

Nothing outside this folder imports it.  Functions of the package are pickled
by value, so executors need no copy of the library on their own path.
"""

from pyspark import cloudpickle

import strataflow

cloudpickle.register_pickle_by_value(strataflow)
