"""postmill - posting ingest, feedback, ranking and tracking as Spark jobs."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import cloudpickle

# The few Python functions that run inside tasks travel with the job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
