"""Chess move-time analytics as lazy PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks are shipped with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
