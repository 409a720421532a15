"""Library linkage on Spark: ingest, normalise, link, plan, reconcile and report.

Every public operator takes DataFrames and returns a DataFrame (or a Column);
no table is collected on the driver.  Tables carry ``library_id`` so one job
serves a fleet of libraries against one catalog.
"""

import sys

from pyspark import cloudpickle

# functions used in tasks travel with the task: executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sinks", "sources", "streaming"]
