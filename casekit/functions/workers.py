"""Make library code that runs inside Python workers self-contained.

Functions handed to ``mapInPandas`` / pandas UDFs are pickled by reference
when their module is importable on the driver, which would require the
package on every executor.  Registering the module for pickling by value
ships the code with the task instead (``--py-files`` still works too).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_with_tasks(__name__)  # modules shipped whole hold a reference to the function above
