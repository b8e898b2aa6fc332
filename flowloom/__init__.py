"""Network-flow and DNS-abuse analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python parts (capture source, DNS payload, stateful flows) travel to the
# executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
