"""Social-media analytics as Spark DataFrame operators and named analyses."""

import sys

from pyspark import cloudpickle

# helpers used inside tasks travel with the job: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
