"""annolith: label-extraction analytics and corpus curation on PySpark.

Every public operator takes and returns DataFrames.  The package is pickled by
value so that Python workers never need it on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
