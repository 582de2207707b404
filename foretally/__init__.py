"""Panel forecast evaluation as Spark jobs.

Every job works on a panel table ``(series_id, ..., block, t, x)``.  ``block`` is the
unit of work: a series of any length is cut into blocks of bounded size, so no task
ever holds a whole series.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their own code, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
