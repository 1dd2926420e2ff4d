"""folioforge: document-corpus analysis, cleaning and verification as PySpark DataFrame operators.

Functions of this package that run inside Python workers are serialised by value, so executors need not have the
package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
