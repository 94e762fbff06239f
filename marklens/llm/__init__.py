"""Operators for training-data pipelines: thirteen methods over documents, pages and conversations.

Nothing outside this folder, the pipeline module and their tests imports it. Every operator reads only the columns it
is told to (by default `doc_id` and `text`), so any other columns of its input, whatever their names, change nothing.
"""

import sys

from pyspark import cloudpickle

# Code that runs in tasks travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
