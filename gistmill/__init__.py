"""gistmill: keeps a digest of many text and source-file corpora on Spark.

A corpus is a tree of files.  One job lists any number of corpora, drops what the
ignore rules exclude, hashes what is left, compares it with the stored digest, works
out what each new or changed file deserves (skip, size notice, raw copy or summary)
and merges the outcome into the digest.  Every step takes DataFrames and returns a
lazy DataFrame keyed by ``(corpus_id, relative_path)``.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel inside the task, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
