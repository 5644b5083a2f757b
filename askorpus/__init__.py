"""Question-answering corpus analytics on PySpark.

Python helpers used inside tasks are pickled by value, so a cluster needs
nothing of this package installed on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
