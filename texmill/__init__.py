"""texmill: document and formula analytics as Spark DataFrames."""

import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # the driver's small matrices gain nothing from threads
