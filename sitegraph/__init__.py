"""sitegraph: analysis and mining of crawled page snapshots on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# helpers used inside tasks travel with the job; executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
