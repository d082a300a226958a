"""quillstream: Spark-native digest and task analytics.

Library code takes DataFrames and returns DataFrames; nothing is collected
to the driver except already-bounded report rows.
"""

import sys as _sys

__version__ = "0.1.0"

# Python functions that run on executors (pandas UDFs, mapInPandas) are
# shipped by value, so workers need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pickler: fall back to import by name
    pass
